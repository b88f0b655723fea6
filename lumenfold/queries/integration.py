"""Sampling, transforming and evaluating points. Uniforms are of a hash, so DuckDB draws the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions.numeric import coprime_stride, cosine, is_finite, uniform
from lumenfold.operators import evaluate, generate, observe, transform, vegas
from lumenfold.operators.panels import unpermute
from lumenfold.plans.control import TrainingWindow, training_rate_column
from lumenfold.plans.domain import Continuous, nested, rectangular
from lumenfold.plans.geometry import LineRaster, Linspace, PlaneRaster
from lumenfold.queries.registry import query, rounded, table

_U = "CAST(('0x' || substr(md5('{s}:' || i || ':{d}'), 1, 13)) AS BIGINT) / 4503599627370496.0"
_PI = "3.141592653589793"


def _u(d: int, s: int = 0) -> str:
    return _U.format(s=s, d=d)


def _samples_sql(dims: int) -> str:
    return f"p AS (SELECT i, {', '.join(f'{_u(d)} AS u{d}' for d in range(dims))} FROM (SELECT event_id AS i FROM events))"


def _index(spark, sf_dir):
    """A sample for each event."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("sample_index"))


def _cube(spark, sf_dir, dims):
    return generate.naive_points(_index(spark, sf_dir), Continuous(dims))


@query(f"""WITH {_samples_sql(1)}, v AS (SELECT sin(u0) * exp(-u0 * u0) AS f FROM p)
SELECT count(*) AS count, round(avg(f), 6) AS mean, round(sqrt((avg(f * f) - avg(f) * avg(f)) / count(*)), 8) AS stderr FROM v""")
def naive_mc_integral(spark, sf_dir):
    e = evaluate.sine_gauss()
    points = evaluate.evaluate(generate.naive_points(_index(spark, sf_dir), e.domain), e)
    state = points.agg(*observe.scalar_partial(F.col("value"), F.col("weight")))
    out = observe.finalise(state, observe.scalar_estimate())
    return out.select("count", F.round("mean", 6).alias("mean"), F.round("stderr", 8).alias("stderr"))


@query("SELECT event_id, round(sin(value / 100) * exp(-(value / 100) * (value / 100)), 9) AS f FROM events")
def sin_evaluator(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.array(F.col("value") / 100).alias("continuous"), F.array().alias("discrete"))
    return evaluate.evaluate(rows, evaluate.sine_gauss()).select("event_id", F.round("value", 9).alias("f"))


@query("""WITH z AS (SELECT event_id, value / 100 AS x, (event_id % 10) / 10.0 AS y FROM events)
SELECT event_id, round(sin(x) * (exp(y) + exp(-y)) / 2, 9) AS re, round(cos(x) * (exp(y) - exp(-y)) / 2, 9) AS im FROM z""")
def complex_sin_evaluator(spark, sf_dir):
    at = F.array(F.col("value") / 100, (F.col("event_id") % 10) / 10.0)
    out = evaluate.evaluate(table(spark, sf_dir, "events").select("event_id", at.alias("continuous"), F.array().alias("discrete")), evaluate.complex_sine())
    return out.select("event_id", F.round("value.re", 9).alias("re"), F.round("value.im", 9).alias("im"))


@query("SELECT count(*) AS count, round(sum(abs(l_quantity)), 4) AS sum_weighted_value, round(sum(l_quantity), 4) AS training FROM lineitem")
def unit_evaluator(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("weight"), F.array().cast("array<double>").alias("continuous"), F.array().alias("discrete"))
    out = evaluate.training_values(evaluate.evaluate(li, evaluate.unit(0)))
    agg = out.agg(*observe.scalar_partial(F.col("value"), F.col("weight")), F.sum("training").alias("training"))
    return rounded(agg.select("count", "sum_weighted_value", "training"), 4)


@query("SELECT event_id, round(power(x, 2) + power(y, 2) * 3 - sin(x * y) / 2 + greatest(x, y), 6) AS f FROM (SELECT event_id, value / 100 AS x, (event_id % 10) / 10.0 AS y FROM events)")
def expression_evaluator(spark, sf_dir):
    e = evaluate.expression("x^2 + y^2*3 - sin(x*y)/2 + max(x, y)", ["x", "y"])
    at = F.array(F.col("value") / 100, (F.col("event_id") % 10) / 10.0)
    rows = table(spark, sf_dir, "events").select("event_id", at.alias("continuous"), F.array().alias("discrete"))
    return evaluate.evaluate(rows, e).select("event_id", F.round("value", 6).alias("f"))


@query("""WITH e AS (SELECT event_id, value / 100 AS x, (event_id % 10) / 10.0 AS y, event_id % 2 AS graph, event_id % 3 AS channel FROM events)
SELECT event_id, 1.0::DOUBLE AS unit, round(sin(x) * exp(-x * x), 9) AS sine, round(x * y - 2 * y, 9) AS symbolic, round((1 + graph * 10 + channel) * x * y, 9) AS kernel FROM e""")
def registered_integrands(spark, sf_dir):
    """Integrands by their configuration, one of them a kernel from elsewhere over two discrete axes."""
    kernel = lambda c, d: (1 + d[0] * 10 + d[1]) * c[0] * c[1]
    specs = {
        "unit": {"kind": "unit", "dims": 2}, "sine": {"kind": "sin_evaluator"}, "symbolic": {"kind": "symbolica", "text": "x*y - 2*y", "arguments": ["x", "y"]},
        "kernel": {"kind": "external", "value": kernel, "axes": [("graph", 2), ("channel", 3)], "dims": 2},
    }
    i = F.col("event_id")
    points = table(spark, sf_dir, "events").select("event_id", F.array(F.col("value") / 100, (i % 10) / 10.0).alias("continuous"), F.array(i % 2, i % 3).alias("discrete"))
    for name, spec in specs.items():
        points = evaluate.evaluate(points, evaluate.build(spec)).withColumnRenamed("value", name)
    return rounded(points.select("event_id", *specs), 9)


def _coordinates(points, digits=6):
    return points.select("sample_index", *[F.round(F.col("continuous")[d], digits).alias(f"x{d}") for d in range(3)], F.round("weight", digits).alias("weight"))


@query(f"""WITH {_samples_sql(3)}, a AS (SELECT *, u0 / (1 - u0) AS r, 2 * u1 - 1 AS c, sqrt(greatest(0, 1 - (2 * u1 - 1) * (2 * u1 - 1))) AS s, 2 * {_PI} * u2 AS f FROM p)
SELECT i AS sample_index, round(r * s * cos(f) / (1 + r), 6) AS x0, round(r * s * sin(f) / (1 + r), 6) AS x1, round(r * c / (1 + r), 6) AS x2,
  round(4 * {_PI} * r * r / ((1 - u0) * (1 - u0)) * exp(-6 * r) , 6) AS weight FROM a""")
def spherical_transform(spark, sf_dir):
    # far points are scaled down for the comparison of digits
    out = transform.spherical(_cube(spark, sf_dir, 3))
    c = F.col("continuous")
    r = F.sqrt(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])
    out = out.withColumn("weight", F.col("weight") * F.exp(-6 * r)).withColumn("continuous", F.transform(c, lambda x: x / (1 + r)))
    return _coordinates(out)


@query(f"""WITH {_samples_sql(2)} SELECT i AS sample_index, round(u0 * cos(2 * {_PI} * u1), 6) AS x0, round(u0 * sin(2 * {_PI} * u1), 6) AS x1,
  round(2 * {_PI} * u0, 6) AS weight FROM p""")
def unit_ball_2d(spark, sf_dir):
    return _coordinates(transform.unit_ball(_cube(spark, sf_dir, 2), 2).withColumn("continuous", F.concat("continuous", F.array(F.lit(0.0))))).drop("x2")


@query(f"""WITH {_samples_sql(3)} SELECT i AS sample_index, round(u0 * cos({_PI} * u1), 6) AS x0, round(u0 * sin({_PI} * u1) * cos(2 * {_PI} * u2), 6) AS x1,
  round(u0 * sin({_PI} * u1) * sin(2 * {_PI} * u2), 6) AS x2, round(2 * {_PI} * {_PI} * u0 * u0 * sin({_PI} * u1), 6) AS weight FROM p""")
def unit_ball_3d(spark, sf_dir):
    return _coordinates(transform.unit_ball(_cube(spark, sf_dir, 3), 3))


@query(f"""WITH {_samples_sql(4)} SELECT count(*) AS count, round(avg(2 * power({_PI}, 3) * power(u0, 3) * power(sin({_PI} * u1), 2) * sin({_PI} * u2)), 6) AS volume FROM p""")
def unit_ball_nd(spark, sf_dir):
    points = transform.unit_ball(_cube(spark, sf_dir, 4), 4)
    return points.agg(F.count("*").alias("count"), F.round(F.avg("weight"), 6).alias("volume"))


@query(f"""WITH {_samples_sql(3)}, b AS (SELECT *, u0 / (1 - u0) AS r FROM p)
SELECT count(*) AS count, round(avg(4 * {_PI} * r * r / ((1 - u0) * (1 - u0)) * exp(-r * r)), 6) AS mean FROM b""")
def transform_chain(spark, sf_dir):
    points = transform.chain(_cube(spark, sf_dir, 3), transform.build([{"kind": "spherical"}], 3))
    c = F.col("continuous")
    f = F.exp(-(c[0] * c[0] + c[1] * c[1] + c[2] * c[2])) * F.col("weight")
    return points.agg(F.count("*").alias("count"), F.round(F.avg(f), 6).alias("mean"))


def _visits(spark, sf_dir, count, *columns):
    """Events as visits of a raster of so many pixels, again and again."""
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % count).alias("sample_index"), *columns)


_LINE = LineRaster((1.0, -1.0), (0.5, 2.0), Linspace(0.0, 4.0, 1001), (3,))
_PLANE = PlaneRaster((0.0, 1.0, 0.0), (1.0, 0.0, 0.5), (0.0, 1.0, 0.0), Linspace(-2.0, 2.0, 64), Linspace(0.0, 1.0, 50))


@query(f"""WITH p AS (SELECT event_id, (event_id % 1001 * {coprime_stride(1001)}) % 1001 AS k FROM events) SELECT event_id, k AS pixel, round(1.0 + k / 1000.0 * 4.0 * 0.5, 9) AS x,
  round(-1.0 + k / 1000.0 * 4.0 * 2.0, 9) AS y, 3::BIGINT AS d FROM p""")
def raster_line(spark, sf_dir):
    """The pixel of a line that each event visits."""
    c = F.col("continuous")
    return generate.line_points(_visits(spark, sf_dir, 1001), _LINE).select("event_id", "pixel", F.round(c[0], 9).alias("x"), F.round(c[1], 9).alias("y"), F.col("discrete")[0].alias("d"))


@query(f"""WITH p AS (SELECT event_id, (event_id % 3200 * {coprime_stride(3200)}) % 3200 AS k FROM events), q AS (SELECT *, -2.0 + (k % 64) / 63.0 * 4.0 AS u, (k // 64) / 49.0 AS v FROM p)
SELECT event_id, k AS pixel, round(u, 9) AS x, round(1.0 + v, 9) AS y, round(u * 0.5, 9) AS z FROM q""")
def raster_plane(spark, sf_dir):
    c = F.col("continuous")
    return generate.plane_points(_visits(spark, sf_dir, 3200), _PLANE).select("event_id", "pixel", *[F.round(c[d], 9).alias(n) for d, n in enumerate("xyz")])


@query(f"SELECT event_id, (event_id % 10000 * {coprime_stride(10_000)}) % 10000 AS pixel FROM events")
def raster_permutation(spark, sf_dir):
    return generate.line_points(_visits(spark, sf_dir, 10_000), LineRaster((0.0,), (1.0,), Linspace(0.0, 1.0, 10_000))).select("event_id", "pixel")


@query(f"""WITH v AS (SELECT (event_id % 3200 * {coprime_stride(3200)}) % 3200 AS pixel, max(value) AS value FROM events WHERE event_id % 10 <> 9 GROUP BY 1)
SELECT range AS pixel, v.value FROM range(3200) LEFT JOIN v ON v.pixel = range""")
def image_unpermute(spark, sf_dir):
    """The largest value of the events that visit each pixel; null where none does."""
    visits = _visits(spark, sf_dir, 3200, "value").where("event_id % 10 <> 9").groupBy("sample_index").agg(F.max("value").alias("value"))
    out = unpermute(visits, 3200, ["value"])
    return out.select("pixel", F.when(is_finite(F.col("value")), F.col("value")).alias("value"))


@query(f"""WITH p AS (SELECT i, {_u(0)} AS u, {_u(1)} AS l FROM (SELECT event_id AS i FROM events))
SELECT floor(l * 6)::BIGINT // 3 AS graph, floor(l * 6)::BIGINT % 3 AS channel, count(*) AS n, round(avg(u), 6) AS mean FROM p GROUP BY 1, 2""")
def nested_domain_points(spark, sf_dir):
    points = generate.nested_uniform(_index(spark, sf_dir), nested([("graph", 2), ("channel", 3)], 1))
    d = F.col("discrete")
    return points.groupBy(d[0].alias("graph"), d[1].alias("channel")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("continuous")[0]), 6).alias("mean"))


@query(f"""WITH p AS (SELECT i, {_u(0)} AS u0, {_u(1)} AS u1, floor({_u(2)} * 4294967296)::BIGINT AS d FROM (SELECT event_id AS i FROM events))
SELECT i AS sample_index, round(u0, 9) AS x, round(u1, 9) AS y, d FROM p""")
def naive_points(spark, sf_dir):
    c = F.col("continuous")
    return generate.naive_points(_index(spark, sf_dir), rectangular(2, 1)).select("sample_index", F.round(c[0], 9).alias("x"), F.round(c[1], 9).alias("y"), F.col("discrete")[0].alias("d"))


@query("SELECT event_id AS batch_id, event_id % 7 AS n, event_id % 7 - 1 AS last FROM events WHERE event_id % 7 > 0")
def latent_batches(spark, sf_dir):
    """Batches that events describe, opened: how many samples each has, and the last one's number."""
    opened = generate.batch_samples(_latent(spark, sf_dir))
    return opened.groupBy("batch_id").agg(F.count("*").alias("n"), F.max("sample_index").alias("last"))


def _latent(spark, sf_dir):
    return generate.latent_batches(table(spark, sf_dir, "events").select(F.col("event_id").alias("batch_id"), (F.col("event_id") % 7).alias("nr_samples")), 11)


@query(f"""WITH p AS (SELECT i, {_u(0)} AS x, {_u(1)} AS y FROM (SELECT event_id AS i FROM events)), f AS (SELECT x, y, exp(-20 * ((x - 0.3) * (x - 0.3) + (y - 0.7) * (y - 0.7))) AS f FROM p)
SELECT 0 AS axis, floor(x * 16)::INT AS bin, round(sum(f * f), 6) AS mass, count(*) AS n FROM f GROUP BY 2
UNION ALL SELECT 1, floor(y * 16)::INT, round(sum(f * f), 6), count(*) FROM f GROUP BY 2""")
def vegas_window_histogram(spark, sf_dir):
    rows = vegas.sample(_index(spark, sf_dir), vegas.Grid.uniform(2, 16), 0)
    return rounded(vegas.window_sums(rows, _peak(F.col("continuous")), 2).where("axis >= 0"))


def _peak(c):
    return F.exp(-20 * ((c[0] - 0.3) * (c[0] - 0.3) + (c[1] - 0.7) * (c[1] - 0.7)))


def _trained(spark, sf_dir, windows: int) -> vegas.Training:
    """A grid trained on the events as samples, a fifth of them in each window."""
    events = _index(spark, sf_dir)
    n = events.count() // windows
    start = vegas.Training(vegas.Grid.uniform(2, 32), seed=3, target=windows * n, window=n, initial_rate=0.7, final_rate=0.3)
    return start.run(lambda a, b: events.where((F.col("sample_index") >= a) & (F.col("sample_index") < b)), lambda points: _peak(F.col("continuous")))


@query()
def vegas_train(spark, sf_dir):
    """The bin that each event falls into once the grid is trained, by dimension: how many events and how wide."""
    grid = _trained(spark, sf_dir, 5).grid
    points = vegas.sample(_index(spark, sf_dir), grid, 3)
    cells = points.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"bin_{d}").alias("bin")) for d in range(2)])).alias("c"))
    lows = F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in grid.edges])
    edge = lambda i: F.element_at(F.element_at(lows, F.col("dim") + 1), F.col("bin") + i)
    return cells.groupBy("c.dim", "c.bin").agg(F.count("*").alias("n")).select("dim", "bin", "n", edge(1).alias("lo"), edge(2).alias("hi"))


@query()
def vegas_inference(spark, sf_dir):
    """The integral of a peak from latent batches that events describe, drawn from the trained grid, and its error."""
    points = vegas.infer(_latent(spark, sf_dir), _trained(spark, sf_dir, 5).grid)
    state = points.agg(*observe.scalar_partial(_peak(F.col("continuous")), F.col("weight")))
    return observe.finalise(state, observe.scalar_estimate()).select("count", "mean", "stderr")


@query("""SELECT event_id, round(0.8 * power(0.1 / 0.8, least(event_id % 101, 80) / 80.0), 9) AS geometric, round(0.0 + (0.5 - 0.0) * least(event_id % 101, 80) / 80.0, 9) AS linear FROM events""")
def training_rate_schedule(spark, sf_dir):
    rates = [F.round(training_rate_column(a, b, F.col("event_id") % 101, 80), 9).alias(name) for name, a, b in (("geometric", 0.8, 0.1), ("linear", 0.0, 0.5))]
    return table(spark, sf_dir, "events").select("event_id", *rates)


@query("""SELECT event_id, greatest(0, least(4000 - event_id % 4100 - user_id % 17, 16 - event_id % 4100 % 16)) AS budget FROM events""")
def window_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", TrainingWindow(4000, 16).budget_column(F.col("event_id") % 4100, F.col("user_id") % 17).alias("budget"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS norm, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 5) AS turned FROM embeddings")
def vector_products(spark, sf_dir):
    from lumenfold.functions.numeric import dot

    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(v, v), 5).alias("norm"), F.round(cosine(v, F.reverse(v)), 5).alias("turned"))


@query(f"SELECT i, round({_u(0, 9)}, 12) AS u FROM (SELECT event_id AS i FROM events)")
def counter_uniforms(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.round(uniform(9, F.col("event_id"), 0), 12).alias("u"))
