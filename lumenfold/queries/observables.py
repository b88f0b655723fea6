"""Aggregates of weighted samples: lineitem's discount and tax stand for values, its quantity for weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions.numeric import complex_of
from lumenfold.operators import evaluate, observe, scan
from lumenfold.queries.registry import query, rounded, table

# the same sums and estimates for DuckDB
_SCALAR = """count(*) FILTER (ok) AS count, round(coalesce(sum(wv) FILTER (ok), 0), 6) AS sum_weighted_value, round(coalesce(sum(abs(wv)) FILTER (ok), 0), 6) AS sum_abs,
  round(coalesce(sum(wv * wv) FILTER (ok), 0), 6) AS sum_sq, count(*) FILTER (NOT ok) AS nan_count"""
_SAMPLES = "v AS (SELECT *, l_discount * abs(l_quantity / 50) AS wv, true AS ok FROM lineitem)"
_ESTIMATE = """round(m, 6) AS mean, round(a, 6) AS mean_abs, round(greatest(q - m * m, 0), 6) AS variance, round(sqrt(greatest(q - m * m, 0) / n), 6) AS stderr,
  round(a * a / (greatest(q - m * m, 0) / n), 2) AS signal_to_noise, round(greatest(q - m * m, 0) / (a * a), 6) AS rsd"""


def _samples(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("value", F.col("l_discount")).withColumn("weight", F.col("l_quantity") / 50)


@query(f"WITH {_SAMPLES} SELECT l_returnflag, {_SCALAR} FROM v GROUP BY l_returnflag")
def scalar_observable(spark, sf_dir):
    return rounded(_samples(spark, sf_dir).groupBy("l_returnflag").agg(*observe.scalar_partial(F.col("value"), F.col("weight"))))


@query(f"""WITH r AS (SELECT user_id, (CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN 'inf'::DOUBLE ELSE value / 100 END)
  * abs(CASE WHEN event_id % 83 = 0 THEN '-inf'::DOUBLE ELSE -1.5 END) AS wv FROM events), v AS (SELECT *, isfinite(wv) AS ok FROM r)
SELECT user_id, {_SCALAR} FROM v GROUP BY user_id""")
def scalar_observable_nonfinite(spark, sf_dir):
    i = F.col("event_id")
    value = F.when(i % 97 == 0, F.lit(float("nan"))).when(i % 89 == 0, F.lit(float("inf"))).otherwise(F.col("value") / 100)
    weight = F.when(i % 83 == 0, F.lit(float("-inf"))).otherwise(-1.5)
    return rounded(table(spark, sf_dir, "events").groupBy("user_id").agg(*observe.scalar_partial(value, weight)))


@query(f"WITH {_SAMPLES} SELECT l_linestatus, {_SCALAR} FROM v GROUP BY l_linestatus")
def observable_merge_two_level(spark, sf_dir):
    batch = (F.col("l_orderkey") % 16).alias("batch_id")
    states = _samples(spark, sf_dir).groupBy("l_linestatus", batch).agg(*observe.scalar_partial(F.col("value"), F.col("weight")))
    return rounded(observe.merge(states, ["l_linestatus"]))


@query(f"""WITH {_SAMPLES}, e AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(wv) / count(*) AS m, sum(abs(wv)) / count(*) AS a, sum(wv * wv) / count(*) AS q
  FROM v GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, {_ESTIMATE} FROM e""")
def signal_to_noise_rsd(spark, sf_dir):
    states = _samples(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(*observe.scalar_partial(F.col("value"), F.col("weight")))
    out = observe.finalise(states, observe.scalar_estimate(), 6).withColumn("signal_to_noise", F.round("signal_to_noise", 2))
    return out.select("l_returnflag", "l_linestatus", *observe.scalar_estimate())


@query("""WITH z AS (SELECT l_returnflag, l_discount * w AS re, l_tax * w AS im, sqrt(l_discount * l_discount + l_tax * l_tax) * w AS a, w
  FROM (SELECT *, abs(l_quantity / 50) AS w FROM lineitem)),
s AS (SELECT l_returnflag, count(*) AS n, sum(re) AS r, sum(im) AS i, sum(a) AS a, sum(a * a) AS aa, sum(re * re) AS rr, sum(im * im) AS ii, sum(w) AS w FROM z GROUP BY 1)
SELECT l_returnflag, n AS count, round(r / n, 6) AS real_mean, round(i / n, 6) AS imag_mean, round(a / n, 6) AS abs_mean,
  round(sqrt(greatest(rr / n - (r / n) * (r / n), 0) / n), 6) AS real_stderr, round(sqrt(greatest(ii / n - (i / n) * (i / n), 0) / n), 6) AS imag_stderr,
  round(sqrt(greatest(aa / n - (a / n) * (a / n), 0) / n), 6) AS abs_stderr, round(w, 4) AS weight_sum,
  round(greatest(aa / n - (a / n) * (a / n), 0) / ((a / n) * (a / n)), 6) AS rsd FROM s""")
def complex_observable(spark, sf_dir):
    li = _samples(spark, sf_dir)
    batch = (F.col("l_orderkey") % 7).alias("batch_id")
    states = li.groupBy("l_returnflag", batch).agg(*observe.complex_partial(complex_of(F.col("l_discount"), F.col("l_tax")), F.col("weight")))
    merged = observe.merge(states, ["l_returnflag"], observe.COMPLEX_STATE)
    out = observe.finalise(merged, observe.complex_estimate(), 6).withColumn("weight_sum", F.round("weight_sum", 4))
    means = ("real_mean", "imag_mean", "abs_mean", "real_stderr", "imag_stderr", "abs_stderr")
    return out.select("l_returnflag", "count", *means, "weight_sum", "rsd")


@query("""WITH r AS (SELECT event_id AS sample_index, (CASE WHEN event_id % 101 = 0 THEN 'nan'::DOUBLE ELSE value END) * abs(event_id % 3 - 1.0) AS wv FROM events)
SELECT sample_index, round(CASE WHEN isfinite(wv) THEN wv ELSE 0 END, 6) AS value, NOT isfinite(wv) AS is_nan FROM r""")
def full_scalar_nan_positions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 101 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    weight = (F.col("event_id") % 3 - 1).cast("double")
    return rounded(observe.full_scalar(e.select(F.col("event_id").alias("sample_index"), value.alias("value"), weight.alias("weight"))))


@query("""WITH r AS (SELECT event_id AS sample_index, CASE WHEN event_id % 101 = 0 THEN 'nan'::DOUBLE ELSE value END * abs(event_id % 3 - 1.0) AS re, (event_id % 7) * abs(event_id % 3 - 1.0) AS im FROM events)
SELECT sample_index, CASE WHEN isnan(re) THEN 0 ELSE round(re, 6) END AS re, CASE WHEN isnan(re) THEN 0 ELSE round(im, 6) END::DOUBLE AS im, isnan(re) AS is_nan FROM r""")
def full_complex_nan_positions(spark, sf_dir):
    i = F.col("event_id")
    re = F.when(i % 101 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select(i.alias("sample_index"), complex_of(re, i % 7).alias("value"), (i % 3 - 1).cast("double").alias("weight"))
    return rounded(observe.full_complex(rows))


@query("""WITH v AS (SELECT user_id % 8 AS run_id, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE value END AS v FROM events),
s AS (SELECT run_id, count(*) AS processed, count(*) FILTER (NOT isnan(v)) AS n, count(*) FILTER (isnan(v)) AS nan_count, avg(v) FILTER (NOT isnan(v)) AS m, avg(v * v) FILTER (NOT isnan(v)) AS q FROM v GROUP BY 1)
SELECT run_id, n AS count, nan_count, round(m, 6) AS mean, round(sqrt(greatest(q - m * m, 0) / n), 6) AS stderr, processed FROM s""")
def observable_digests(spark, sf_dir):
    """Digests of scalar states, beside what is kept of the full fields of the same samples."""
    v = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("run_id"), F.col("event_id").alias("sample_index"), v.alias("value"), F.lit(1.0).alias("weight"))
    states = observe.persistent(rows.groupBy("run_id").agg(*observe.scalar_partial(F.col("value"), F.col("weight"))), ["run_id"], "scalar")
    return rounded(observe.digest(states, ["run_id"]).join(observe.persistent(rows, ["run_id"], "full_scalar"), "run_id"))


@query("""WITH r AS (SELECT user_id AS batch_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value FROM events)
SELECT batch_id, row_number() OVER (ORDER BY batch_id, i) - 1 AS position, value FROM r""")
def full_merge_offsets(spark, sf_dir):
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    parts = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch_id"), order.cast("bigint").alias("sample_index"), "value")
    return observe.full_merge(parts).select("batch_id", "position", "value")


@query("SELECT min(value) AS low, max(value) AS high, max(sqrt(value * value + (event_id % 7) * (event_id % 7))) AS largest FROM events")
def full_extrema(spark, sf_dir):
    z = complex_of(F.col("value"), F.col("event_id") % 7)
    size = F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])
    return table(spark, sf_dir, "events").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max(size).alias("largest"))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS s,
  sum(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DECIMAL(19, 2)) * CAST(o_totalprice AS DECIMAL(18, 2))) AS q FROM orders GROUP BY 1),
c AS (SELECT day, CAST(sum(n) OVER w AS BIGINT) AS n, CAST(sum(s) OVER w AS DOUBLE) AS s, CAST(sum(q) OVER w AS DOUBLE) AS q FROM d WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT CAST(day AS VARCHAR) AS day, n, round(s / n) / 1e6 AS mean, round(sqrt(greatest(q / n - (s / n) * (s / n), 0) / n)) / 1e6 AS stderr FROM c""")
def estimate_history_band(spark, sf_dir):
    day = F.col("o_orderdate").cast("date").alias("day")
    price = F.col("o_totalprice").cast("decimal(18,2)")  # decimals have the same sum in any order
    states = table(spark, sf_dir, "orders").groupBy(day).agg(F.count("*").alias("n"), F.sum(price).alias("s"), F.sum(price * price).alias("q"))
    upto = scan.running_sums(states, ["day"], ["n", "s", "q"], target=256)  # a row per day
    upto = upto.select(F.col("day").cast("string").alias("day"), "n", F.col("s").cast("double").alias("s"), F.col("q").cast("double").alias("q"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)) / F.col("n"))
    # rounded while halves are still exact
    return upto.select("day", "n", (F.round(mean) / 1e6).alias("mean"), (F.round(spread) / 1e6).alias("stderr"))


@query("""WITH d AS (SELECT l_shipmonth, count(*) AS n, avg(l_discount) AS m, greatest(avg(l_discount * l_discount) - avg(l_discount) * avg(l_discount), 0) AS v
  FROM (SELECT *, CAST(month(l_shipdate) AS INT) AS l_shipmonth FROM lineitem) GROUP BY 1)
SELECT l_shipmonth, round(m, 6) AS mean, round((m - 0.05) / sqrt(v / n), 4) AS pull FROM d""")
def target_pull(spark, sf_dir):
    states = table(spark, sf_dir, "lineitem").groupBy(F.month("l_shipdate").alias("l_shipmonth")).agg(*observe.scalar_partial(F.col("l_discount"), F.lit(1.0)))
    e = observe.scalar_estimate()
    out = observe.finalise(states, {"mean": e["mean"], "stderr": e["stderr"]})
    return out.select("l_shipmonth", F.round("mean", 6).alias("mean"), F.round(observe.pull(F.col("mean"), F.col("stderr"), F.lit(0.05)), 4).alias("pull"))


@query("""SELECT l_linestatus, round(sum(l_discount * w), 6) AS real, round(sum(l_tax * w), 6) AS imag, round(sum(sqrt(l_discount * l_discount + l_tax * l_tax) * w), 6) AS abs,
  round(sum((l_discount * l_discount + l_tax * l_tax) * w), 6) AS abs_sq FROM (SELECT *, (l_quantity - 25) / 50 AS w FROM lineitem) GROUP BY 1""")
def training_projection(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("value", complex_of(F.col("l_discount"), F.col("l_tax"))).withColumn("weight", (F.col("l_quantity") - 25) / 50)
    sums = [F.sum(evaluate.training_projection(F.col("value"), k) * F.col("weight")).alias(k) for k in ("real", "imag", "abs", "abs_sq")]
    return rounded(li.groupBy("l_linestatus").agg(*sums))


_BINS = "CASE WHEN value < 10 THEN 0 WHEN value >= 110 THEN 21 ELSE least(CAST(floor((value - 10) / 5.0) AS INT) + 1, 20) END"


@query(f"""SELECT event_type, {_BINS} AS bin, count(*) AS entry_count, round(sum(1 + event_id % 3), 6)::DOUBLE AS sum_weights,
  round(sum((1 + event_id % 3) * (1 + event_id % 3)), 6)::DOUBLE AS sum_weights_squared FROM events GROUP BY 1, 2""")
def histogram_fill(spark, sf_dir):
    return rounded(observe.fill_histogram(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), 1 + F.col("event_id") % 3, 10, 110, 20))


@query(f"""WITH h AS (SELECT event_type, {_BINS} AS bin, count(*) AS n, sum(1.0 + event_id % 3) AS w, sum((1.0 + event_id % 3) * (1.0 + event_id % 3)) AS q FROM events GROUP BY 1, 2),
t AS (SELECT event_type, count(*) AS total FROM events GROUP BY 1)
SELECT event_type, bin, n AS entry_count, round(w / total, 6) AS value, round(sqrt(greatest(q / total - (w / total) * (w / total), 0) / total), 6) AS error
FROM h JOIN t USING (event_type) WHERE bin BETWEEN 1 AND 20""")
def histogram_finalise(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = observe.fill_histogram(e.withColumn("batch_id", F.col("user_id") % 8), ["event_type", "batch_id"], F.col("value"), 1 + F.col("event_id") % 3, 10, 110, 20)
    merged = observe.merge(parts, ["event_type", "bin"], observe.HISTOGRAM_STATE)
    samples = e.groupBy("event_type").agg(F.count("*").alias("total"))
    out = merged.join(samples, "event_type").where("bin between 1 and 20")
    return rounded(observe.finalise(out, observe.histogram_estimate(F.col("total"))).select("event_type", "bin", "entry_count", "value", "error"))


@query("""SELECT vec_id, len(embedding)::INT AS n, list_aggregate(list_transform(embedding, lambda x: (NOT isfinite(x))::INT), 'sum') > 0
  OR vec_id % 10 = 0 AS unsafe FROM embeddings""")
def json_safety(spark, sf_dir):
    values = F.when(F.col("vec_id") % 10 == 0, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), observe.not_json_safe(values).alias("unsafe"))


@query("""SELECT event_id AS batch_id FROM events WHERE (event_id % 5 = 0) OR (event_id % 2 = 0 AND event_id % 7 = 0)""")
def training_value_mismatches(spark, sf_dir):
    i = F.col("event_id")
    given = F.when((i % 2 == 0) != (i % 5 == 0), F.array_repeat(F.col("value"), F.when(i % 7 == 0, 2).otherwise(3)))
    rows = table(spark, sf_dir, "events").select(i.alias("batch_id"), F.lit(3).alias("nr_samples"), (i % 2 == 0).alias("required"), given.alias("values"))
    return evaluate.training_mismatches(rows)
