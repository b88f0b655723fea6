"""Ordered scans against plain Python, with one key over many blocks."""

import random

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import panels, queue, rolling, scan

rnd = random.Random(4)
#: A hot key, small ones, ties in the first order column.
ROWS = [("hot" if i % 3 else f"k{i % 7}", rnd.randrange(400), i, rnd.choice([None, rnd.uniform(-1, 50), float("nan")]) if i % 11 == 0 else rnd.uniform(0, 50)) for i in range(1500)]
DDL = "k string, t bigint, id bigint, x double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(5).cache()


def by_key():
    out = {}
    for k, t, i, x in sorted(ROWS, key=lambda r: (r[1], r[2])):
        out.setdefault(k, []).append((t, i, x))
    return out


@pytest.mark.parametrize("target", [20, 400, 10**6])
def test_moving_average_composes(rows, target):
    wanted = {}
    for k, seen in by_key().items():
        mean, variance, n = None, 0.0, 0
        for _, _, x in seen:
            if x is not None and x == x and x >= 0:
                mean, variance = rolling.ewma_step(mean, variance, x)
                n += 1
        wanted[k] = (mean, variance, n)
    found = {r["k"]: (r["mean"], r["variance"], r["n"]) for r in rolling.ewma(rows, ["k"], ["t", "id"], "x", target=target).collect()}
    assert found.keys() == wanted.keys()
    for k in wanted:
        assert found[k] == pytest.approx(wanted[k], rel=1e-9, abs=1e-9)


def test_long_stretches_compose_over_levels(spark):
    n = 3 * scan.FAN * scan.FAN // 4
    rows = spark.range(n).select(F.lit(1).alias("k"), F.col("id"), (F.col("id") % 97).cast("double").alias("x"))
    mean, variance = None, 0.0
    for i in range(n):
        mean, variance = rolling.ewma_step(mean, variance, float(i % 97))
    found = rolling.ewma(rows, ["k"], ["id"], "x", target=10**9).first()
    assert (found["mean"], found["variance"], found["n"]) == (pytest.approx(mean), pytest.approx(variance), n)


@pytest.mark.parametrize("target", [10, 10**6])
def test_positions_and_downsampling(rows, target):
    wanted = {(k, i): (place, len(seen)) for k, seen in by_key().items() for place, (_, i, _) in enumerate(seen)}
    found = scan.positions(rows, ["k"], ["t", "id"], "place", "n", target).collect()
    assert {(r["k"], r["id"]): (r["place"], r["n"]) for r in found} == wanted
    kept = panels.downsample(rows, ["k"], ["t", "id"], 64, target).collect()
    assert {(r["k"], r["id"]) for r in kept} == {(k, i) for (k, i), (p, n) in wanted.items() if p % (1 << max(0, (n - 1).bit_length() - 6)) == 0 or p == n - 1}


@pytest.mark.parametrize("target", [10, 10**6])
def test_running_sums(rows, target):
    one = rows.groupBy("t").agg(F.count("*").alias("n"), F.sum(F.lit(2).cast("decimal(10,2)")).alias("d"))
    counts, upto, wanted = {}, 0, {}
    for _, t, _, _ in ROWS:
        counts[t] = counts.get(t, 0) + 1
    for t in sorted(counts):
        upto += counts[t]
        wanted[t] = (upto, 2 * upto)
    found = scan.running_sums(one, ["t"], ["n", "d"], target=target)
    assert {r["t"]: (r["n"], r["d"]) for r in found.collect()} == wanted
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("target", [10, 10**6])
def test_as_of_over_many_ranges(rows, target):
    left = rows.where("id % 2 = 0").select("id", "k", "t")
    right = rows.where("id % 2 = 1").select("id", "k", "t", "x")
    wanted = {}
    for k, t, i, _ in ROWS:
        if i % 2 == 0:
            earlier = [(u, j) for h, u, j, _ in ROWS if h == k and j % 2 and u < t]
            wanted[i] = max(earlier)[1] if earlier else None
    found = queue.as_of_join(left, right, "k", "t", "t", ["x"], target=target)
    assert {r["id"]: r["snapshot_id"] for r in found.collect()} == wanted


def test_empty_tables(spark):
    none = spark.createDataFrame([], DDL)
    assert rolling.ewma(none, ["k"], ["t", "id"], "x").count() == 0
    assert scan.positions(none, ["k"], ["t", "id"], "p").count() == 0
    assert scan.running_sums(none.select("t", F.lit(1).alias("n")), ["t"], ["n"]).count() == 0
    assert queue.as_of_join(none, none.withColumnRenamed("x", "y"), "k", "t", "t", ["y"]).count() == 0
