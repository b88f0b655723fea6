"""Golden values and invariants of points, aggregates, grids, tasks and state tables."""

import json
import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lumenfold.functions.display import estimate_with_error, flatten_json, flatten_json_column, required_downsample_level
from lumenfold.functions.numeric import complex_of, coprime_stride
from lumenfold.operators import generate, observe, panels, vegas
from lumenfold.plans.control import TrainingWindow
from lumenfold.plans.tasks import Source, parse_task, preflight, view_mode
from lumenfold.queries import QUERIES
from lumenfold.sources.state import StateStore, load_template, merge_config

NAN, INF = float("nan"), float("inf")


def scalar(spark, rows):
    return spark.createDataFrame(rows, "v double, w double").agg(*observe.scalar_partial(F.col("v"), F.col("w"))).first().asDict()


def complex_state(spark, rows):
    df = spark.createDataFrame(rows, "re double, im double, w double")
    return df.agg(*observe.complex_partial(complex_of(F.col("re"), F.col("im")), F.col("w"))).first().asDict()


def test_scalar_state_takes_absolute_weights(spark):
    assert scalar(spark, [(2.0, -3.0)]) == {"count": 1, "sum_weighted_value": 6.0, "sum_abs": 6.0, "sum_sq": 36.0, "nan_count": 0}


def test_scalar_state_counts_what_is_not_finite_apart(spark):
    assert scalar(spark, [(NAN, 1.0), (1.0, INF)]) == {"count": 0, "sum_weighted_value": 0.0, "sum_abs": 0.0, "sum_sq": 0.0, "nan_count": 2}


def test_complex_state(spark):
    state = complex_state(spark, [(3.0, 4.0, 2.0)])
    assert [state[k] for k in ("real_sum", "imag_sum", "abs_sum", "real_sq_sum", "imag_sq_sum", "abs_sq_sum", "weight_sum")] == [6, 8, 10, 36, 64, 100, 2]
    negative = complex_state(spark, [(1.5, -2.0, -3.0)])
    assert [negative[k] for k in ("real_sum", "imag_sum", "weight_sum")] == [4.5, -6, 3]
    assert complex_state(spark, [(NAN, 1.0, 1.0), (1.0, 0.0, INF)])["nan_count"] == 2


def test_merging_partials_equals_one_pass(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("b"), (F.col("id") / 10).alias("v"), F.lit(0.5).alias("w"))
    whole = rows.agg(*observe.scalar_partial(F.col("v"), F.col("w"))).first()
    merged = observe.merge(rows.groupBy(F.lit(1).alias("k"), "b").agg(*observe.scalar_partial(F.col("v"), F.col("w"))), ["k"]).first()
    assert merged["count"] == whole["count"] and math.isclose(merged["sum_sq"], whole["sum_sq"])


@pytest.mark.parametrize("n", range(2, 32))
def test_raster_order_visits_every_pixel_once(n):
    stride = coprime_stride(n)
    assert math.gcd(stride, n) == 1 and sorted(i * stride % n for i in range(n)) == list(range(n))


def test_estimates_are_written_with_two_digits_of_the_error(spark):
    df = spark.createDataFrame([(1234.56, 12.34), (0.0, 0.0), (-9876.0, 100.0)], "m double, e double")
    found = [r[0] for r in df.select(estimate_with_error(F.col("m"), F.col("e"))).collect()]
    assert found == ["(1.235 +- 0.012) x 10^3", "(0 +- 0) x 10^0", "(-9.88 +- 0.10) x 10^3"]


def test_training_budget_pauses_until_a_window_is_ingested():
    window = TrainingWindow(40, 16)
    steps = [(0, 0), (0, 5), (5, 0), (5, 11), (16, 0), (32, 0), (32, 8), (40, 0)]
    assert [window.plan(*x) for x in steps] == [16, 0, 11, 0, 16, 8, 0, None]


def test_grid_survives_writing(spark):
    grid = vegas.Grid.uniform(2, 8, 3)
    assert vegas.Grid.from_json(grid.to_json()) == grid and grid.matches(2, 3) and not grid.matches(2)


def test_trained_grid_gives_the_integral_and_a_smaller_error_than_uniform_points(spark):
    found = QUERIES["vegas_inference"](spark, "/root/testdata/sf0.1").first()
    root = math.sqrt(20)
    axis = lambda c: math.sqrt(math.pi) / (2 * root) * (math.erf(root * (1 - c)) + math.erf(root * c))
    true = axis(0.3) * axis(0.7)
    assert abs(found["mean"] - true) < 5 * found["stderr"]
    variance = (math.pi / 40) - true * true  # about the squared peak's integral
    assert found["stderr"] < 0.5 * math.sqrt(variance / found["count"])


def test_downsampling_keeps_ends_and_short_series(spark):
    series = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("x"))
    kept = sorted(r["x"] for r in panels.downsample(series, ["k"], ["x"], 256).collect())
    assert kept[0] == 0 and kept[-1] == 999 and len(kept) <= 257
    assert panels.downsample(series.limit(0), ["k"], ["x"]).count() == 0
    assert required_downsample_level(300) == 1 and required_downsample_level(256) == 0


def test_tasks_are_checked():
    with pytest.raises(ValueError):
        parse_task({"kind": "sample", "sampler_aggregator": {"config": {"kind": "havana_training"}}})
    with pytest.raises(ValueError):
        Source.parse({"from_name": " a"})
    tasks = [parse_task({"kind": "sample", "name": "a", "nr_samples": 8}), parse_task({"kind": "sample", "sampler_aggregator": {"from_name": "a"}})]
    assert preflight(tasks) == ["a", "sample-2"]
    with pytest.raises(ValueError):
        preflight(tasks[::-1])
    assert view_mode("plot_line", "auto", True) == "components" and view_mode("image", "auto", False) == "scalar_heatmap"


def test_state_tables_keep_history_and_give_the_latest(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}")
    rows = "run_id int, worker string, version int"
    store.append("metrics", spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 1)], rows))
    store.append("metrics", spark.createDataFrame([(1, "a", 2)], rows))
    latest = store.latest("metrics", ["worker"], ["version"], run_id=1).collect()
    assert sorted((r["worker"], r["version"]) for r in latest) == [("a", 2), ("b", 1)] and store.read("metrics").count() == 4
    store.checkpoint("stages", spark.createDataFrame([(1, 5), (2, 6)], "run_id int, x int"))
    store.checkpoint("stages", spark.createDataFrame([(2, 7)], "run_id int, x int"))
    assert sorted((r["run_id"], r["x"]) for r in store.read("stages").collect()) == [(1, 5), (2, 7)]


def test_configuration(tmp_path):
    assert merge_config({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "b": {"z": 1}}) == {"a": {"x": 1, "y": 3}, "b": {"z": 1}}
    assert flatten_json('{"a": {"b": [1, 2]}, "c": null}') == [("a.b", "[1, 2]"), ("c", "null")]
    with pytest.raises(ValueError):
        load_template(str(tmp_path), "../x.toml")


def test_json_of_any_depth_is_flattened(spark):
    deep: dict = {"v": 20}
    for i in reversed(range(20)):
        deep = {"k": deep, "v": i}
    rows = [(1, json.dumps(deep)), (2, '{"a": {}, "b": [1, null, "x"], "c": null}'), (3, None), (4, "{broken"), (5, "[1]"), (6, '{"a.b": {"": true}}')]
    found = flatten_json_column(spark.createDataFrame(rows, "id int, `c.d` string"), "c.d").collect()
    assert {r["key"]: r["value"] for r in found if r["id"] == 1} == {"k." * i + "v": str(i) for i in range(21)}
    assert sorted((r["id"], r["key"], r["value"]) for r in found if r["id"] > 1) == [(2, "b", "[1, none, x]"), (2, "c", "null"), (6, "a.b.", "true")]


def test_first_k_of_a_key_are_cut_before_the_shuffle(spark):
    plan = QUERIES["completed_prefix"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in before and "row_number(), 16, Partial" in before


def test_training_stops_inside_a_window_and_goes_on_exactly(spark):
    value = lambda points: F.exp(-20 * (F.col("continuous")[0] - 0.3) * (F.col("continuous")[0] - 0.3))
    index = vegas.counted(spark)
    start = vegas.Training(vegas.Grid.uniform(2, 8), seed=1, target=3500, window=1000, initial_rate=0.5, final_rate=0.5)  # a rate that no target changes
    whole = start.run(index, value)
    assert (whole.ingested, whole.updates) == (3500, 3) and whole.partial and whole.diagnostics()["window_remaining"] == 500
    # the same rows up to a target inside the second window, saved, read back, and on to the end
    paused = replace(start, target=1400).run(index, value)
    assert (paused.ingested, paused.updates) == (1400, 1) and sum(m for axis, _, m in paused.partial if axis == 0) > 0
    resumed = vegas.Training.restore(replace(paused, target=3500).snapshot())
    assert resumed.partial == paused.partial and resumed.grid == paused.grid
    resumed = resumed.run(index, value)
    assert resumed.updates == 3
    for a, b in zip(resumed.grid.edges, whole.grid.edges):
        assert a == pytest.approx(b)


def test_snapshots_keep_json_as_variant(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([(1, 7, '{"grid": {"bins": 8}, "seed": null}'), (1, 9, '{"kind": "naive"}'), (2, 8, "[1]")], "run_id int, id long, sampler string")
    store.snapshot("stages", rows, ["sampler"])
    found = store.read("stages", run_id=1)
    assert dict(found.dtypes)["sampler"] == "variant"
    bins = found.select("id", F.try_variant_get("sampler", "$.grid.bins", "int").alias("bins"), F.is_variant_null(F.try_variant_get("sampler", "$.seed", "variant")).alias("no_seed"))
    assert {tuple(r) for r in bins.collect()} == {(7, 8, True), (9, None, False)} or {tuple(r) for r in bins.collect()} == {(7, 8, True), (9, None, None)}


def test_histogram_blocks_are_written_in_order_and_read_back(spark, tmp_path):
    rows = [(k, n, b, float(b), b + 1.0, b * 1.5, 1e-12) for k in ("x", "y") for n in ("b", "a") for b in (2, 1, 3)]
    bins = spark.createDataFrame(rows, "k string, name string, bin int, start double, stop double, value double, error double")
    blocks = panels.hwu_blocks(bins, ["k"], F.col("name"), F.lit(False), F.lit(True))
    panels.write_blocks(blocks, "k", f"file://{tmp_path}/out")
    for k in ("x", "y"):
        (path,) = (tmp_path / "out" / f"k={k}").glob("*.txt")
        lines = path.read_text().splitlines()
        heads = [line for line in lines if line.startswith("<histogram>")]
        assert heads == [f'<histogram> 3 "{n} |X_AXIS@LIN |Y_AXIS@LOG |TYPE@HwU"' for n in "ab"]
        numbers = [tuple(map(float, line.split())) for line in lines if line.startswith("  ")]
        assert numbers == [(float(b), b + 1.0, b * 1.5, 1e-12) for _ in "ab" for b in (1, 2, 3)]


def test_a_table_function_draws_the_points_of_the_column_form(spark):
    batches = spark.createDataFrame([(1, 3, 5), (2, 0, 6), (3, None, 7), (4, 2, 5)], "batch_id long, nr_samples int, seed long")
    key = lambda r: (r["batch_id"], r["sample_index"])
    for dims in (1, 3):
        drawn = {key(r): tuple(r) for r in generate.draw_batches(batches, dims).collect()}
        assert drawn == {key(r): tuple(r) for r in generate.batch_points(batches.where("nr_samples is not null"), dims).collect()} and len(drawn) == 5
