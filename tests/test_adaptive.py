"""Nested grids, bundles of histograms and panels by cursor against plain Python."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumenfold.operators import bundles, nested_grid, observe, pyramid, vegas
from lumenfold.plans.domain import Continuous, Discrete, nested

RAGGED = Discrete("graph", ((0, Continuous(1)), (3, Discrete("channel", ((0, Continuous(2)), (1, Continuous(3)))))))


def test_grid_follows_the_domain(spark):
    grid = nested_grid.NestedGrid.uniform(spark, RAGGED, 4)
    assert grid.depth == 2 and grid.matches(RAGGED) and not grid.matches(nested([("graph", 2)], 1))
    assert sorted((tuple(r["path"]), r["dim"]) for r in grid.edges.collect()) == [((0,), 0), ((3, 0), 0), ((3, 0), 1), ((3, 1), 0), ((3, 1), 1), ((3, 1), 2)]
    with pytest.raises(ValueError):
        nested_grid.NestedGrid.uniform(spark, Continuous(0))
    with pytest.raises(ValueError):
        nested_grid.NestedGrid.uniform(spark, Discrete("graph", ()))


def test_points_do_not_depend_on_partitions_and_fill_the_domain(spark):
    grid = nested_grid.NestedGrid.uniform(spark, RAGGED, 4)
    rows = spark.range(6000).withColumnRenamed("id", "sample_index")
    found = {r["sample_index"]: r for r in nested_grid.draw(rows.repartition(3), grid, 1).collect()}
    again = {r["sample_index"]: r for r in nested_grid.draw(rows.coalesce(1), grid, 1).collect()}
    assert found == again and len(found) == 6000
    dims = {(0,): 1, (3, 0): 2, (3, 1): 3}
    for r in found.values():
        assert len(r["continuous"]) == len(r["bins"]) == dims[tuple(r["discrete"])]
        assert r["weight"] == pytest.approx(2.0 ** len(r["discrete"])) and all(b == int(4 * x) for b, x in zip(r["bins"], r["continuous"]))
    # the weights sum to the number of leaves
    assert sum(r["weight"] for r in found.values()) / 6000 == pytest.approx(3, rel=0.05)


def test_a_number_is_drawn_once_for_each_row(spark):
    """Not for each branch or use: one expression for each level and one for the dimensions of a leaf."""
    points = nested_grid.draw(spark.range(9).withColumnRenamed("id", "sample_index"), nested_grid.NestedGrid.uniform(spark, RAGGED, 4), 1)
    assert points._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 3


def test_partial_windows_add_up_and_refining_follows_the_mass(spark):
    grid = nested_grid.NestedGrid.uniform(spark, RAGGED, 8)
    rows = spark.range(4000).withColumnRenamed("id", "sample_index")
    value = F.exp(-20 * F.col("continuous")[0]) * F.when(F.col("discrete")[0] == 3, 4.0).otherwise(1.0)
    cells = lambda part: nested_grid.window_cells(nested_grid.draw(part, grid, 2), value)
    whole, parts = cells(rows), nested_grid.add_cells(cells(rows.where("sample_index < 1500")), cells(rows.where("sample_index >= 1500")))
    key = lambda r: (tuple(r["path"]), r["dim"], r["bin"])
    one, two = ({key(r): (r["mass"], r["n"]) for r in c.collect()} for c in (whole, parts))
    assert one.keys() == two.keys() and all(one[k] == (pytest.approx(two[k][0]), two[k][1]) for k in one)
    moved = nested_grid.refine(grid, whole, 0.7)
    edges = {(tuple(r["path"]), r["dim"]): r["edges"] for r in moved.edges.collect()}
    mass = [one.get(((3, 0), 0, b), (0.0, 0))[0] for b in range(8)]
    assert edges[(3, 0), 0] == pytest.approx(list(vegas.refine_edges(tuple(i / 8 for i in range(9)), mass, 0.7)))
    assert edges[(3, 0), 0][1] < 0.125 and moved.matches(RAGGED)
    heads = {(tuple(r["path"]), r["branch"]): r["probability"] for r in moved.branches.collect()}
    assert heads[(), 3] > heads[(), 0] and heads[(3,), 0] + heads[(3,), 1] == pytest.approx(1)
    again = nested_grid.draw(rows, moved, 3).agg(F.avg(value * F.col("weight")), F.stddev(value * F.col("weight"))).first()
    flat = nested_grid.draw(rows, grid, 3).agg(F.stddev(value * F.col("weight"))).first()
    true = (1 + 2 * 4) * (1 - math.exp(-20)) / 20
    assert abs(again[0] - true) < 5 * again[1] / math.sqrt(4000) and again[1] < 0.8 * flat[0]


H = [("a", False, -1.0, 1.0, 4), ("z", True, 0.1, 1000.0, 8)]


def test_bundles_merge_to_the_same_whatever_the_batches(spark):
    rnd = random.Random(6)
    special = [float("nan"), None, -1.0, 1.0, 0.0, 0.1, 1000.0, 1e9]
    data = [(i, rnd.choice("xy"), rnd.choice(special) if i % 5 == 0 else rnd.uniform(-2, 3), rnd.choice([1.0, -2.0, 0.5]), i % 7 == 0) for i in range(400)]
    rows = spark.createDataFrame(data, "i long, k string, v double, w double, m boolean")
    three = [bundles.Histogram(n, F.col("v"), lo, hi, b, log) for n, log, lo, hi, b in H]
    wanted = {}
    for _, k, v, w, m in data:
        for name, log, lo, hi, b in H:
            if v is None or math.isnan(v) or (log and v <= 0):
                place = None
            else:
                share = math.log10(v / lo) / math.log10(hi / lo) if log else (v - lo) / (hi - lo)
                place = 0 if v < lo else b + 1 if v >= hi else min(math.floor(share * b) + 1, b)
            n, s, q, c = wanted.get((k, name, place), (0, 0.0, 0.0, 0))
            wanted[k, name, place] = (n + 1, s + w, q + w * w, c + m) if place is not None else (n + 1, 0.0, 0.0, 0)
    for batches in (1, 3, 50):
        states = bundles.fill(rows.withColumn("b", F.col("i") % batches), ["k", "b"], three, F.col("w"), F.col("m"))
        merged = bundles.merge(states, ["k"])
        cells = bundles.opened(merged, ["k"]).where("entries > 0").collect()
        found = {(r["k"], r["name"], r["bin"]): (r["entries"], r["weights"], r["squares"], r["mitigated"]) for r in cells}
        assert found.keys() == wanted.keys() and all(found[c] == pytest.approx(wanted[c]) for c in wanted)
        assert {r["k"]: r["samples"] for r in merged.collect()} == {k: sum(d[1] == k for d in data) for k in "xy"}
        assert {tuple(r)[1:] for r in bundles.primary(merged, ["k"]).collect()} == {(2, "a")}


def test_an_empty_bundle_adopts_and_other_axes_are_refused(spark):
    rows = spark.createDataFrame([(1, 0.5)], "k int, v double")
    fill = lambda high: bundles.fill(rows, ["k"], [bundles.Histogram("a", F.col("v"), 0, high, 2)], F.lit(1.0), F.lit(False))
    none = rows.select("k", F.lit(3).cast("bigint").alias("samples"), F.create_map().cast(bundles.BUNDLE).alias("bundle"))
    merged = bundles.merge(none.unionByName(fill(1.0)), ["k"]).first()
    assert merged["samples"] == 4 and merged["bundle"]["a"]["entries"] == [0, 0, 1, 0]
    assert bundles.merge(none, ["k"]).first()["bundle"] == {}
    with pytest.raises(PySparkException, match="other axes"):
        bundles.merge(fill(1.0).unionByName(fill(2.0)), ["k"]).collect()


def level_of(n, budget):
    level = 0
    while n > budget:
        n, level = -(-n // 2), level + 1
    return level


def written(df):
    """As a table that a reader keeps between its questions."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_answers_in_turn_show_the_whole_series(spark):
    """Appends while the level stays, a whole level when it changes, and nothing for series without news."""
    points = [(k, i) for i in range(300) for k in ("a", "b") if k == "a" or i < 40 or i > 250]
    series = spark.createDataFrame(points, "k string, id long").cache()
    shown, cursors, modes = None, None, []
    for upto in (10, 30, 60, 61, 130, 131, 299):
        found = written(pyramid.answer(series.where(F.col("id") <= upto), ["k"], "id", cursors, 32, target=25))
        cursors, shown = written(pyramid.cursors_of(found, ["k"], cursors)), written(pyramid.applied(shown, found, ["k"]))
        modes.append({r["k"]: r["mode"] for r in found.collect()})
        for k in "ab":
            ids = [i for c, i in points if c == k and i <= upto]
            step = 1 << level_of(len(ids), 32)
            assert sorted(r["id"] for r in shown.collect() if r["k"] == k) == [x for n, x in enumerate(ids) if n % step == 0 or n == len(ids) - 1]
    assert modes[1] == {"a": "append", "b": "append"} and modes[2] == {"a": "replace", "b": "replace"} and modes[3] == {"a": "append"}


def test_cursors(spark):
    rows = spark.createDataFrame([(None,), ("0:3",), ("17",), ("17:2",)], "c string")
    assert [tuple(r) for r in rows.select(*pyramid.parse_cursor(F.col("c"))).collect()] == [(None, 0), (None, 3), (17, 0), (17, 2)]
    with pytest.raises(PySparkException, match="not a cursor"):
        spark.createDataFrame([("x:1",)], "c string").select(*pyramid.parse_cursor(F.col("c"))).collect()


def test_convergence_of_windows(spark):
    windows = [(1, 2.0, 0.5), (1, 3.0, 1.0), (2, 2.5, 0.25), (2, float("nan"), 1.0), (2, 1.0, 0.0)]
    states = spark.createDataFrame(windows, "part int, m double, e double").groupBy("part").agg(*observe.convergence_partial(F.col("m"), F.col("e")))
    one = observe.finalise(observe.merge(states.withColumn("k", F.lit(1)), ["k"], observe.CONVERGENCE_STATE), observe.convergence_estimate()).first()
    w = [4, 1, 16]
    mean = (8 + 3 + 40) / 21
    assert (one["windows"], one["mean"], one["error"]) == (3, pytest.approx(mean), pytest.approx(21**-0.5))
    assert one["chi_sq"] == pytest.approx(sum(a * (m - mean) ** 2 for a, m in zip(w, (2, 3, 2.5))) / 2)
