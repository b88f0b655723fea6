"""Nested grids, bundles of histograms, panels by cursor, and the convergence of training windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import bundles, generate, nested_grid, observe, panels, pyramid
from lumenfold.queries.integration import _u
from lumenfold.queries.registry import query, rounded, table

# a grid of two levels: graphs and channels, over leaves of two dimensions whose bins narrow from leaf to leaf
_GRAPHS = (0.375, 0.625)
_CHANNELS = ((0.5, 0.25, 0.25), (0.125, 0.5, 0.375))
_BINS = 8


def _edges(leaf: int) -> list[float]:
    return [(i / _BINS) ** (1 + leaf / 4) for i in range(_BINS + 1)]


def _grid(spark) -> nested_grid.NestedGrid:
    branches = [([], g, p) for g, p in enumerate(_GRAPHS)] + [([g], c, p) for g, ps in enumerate(_CHANNELS) for c, p in enumerate(ps)]
    return nested_grid.NestedGrid.of(spark, branches, [([g, c], d, _edges(3 * g + c)) for g in range(2) for c in range(3) for d in range(2)])


_DRAWN = f"""g AS (SELECT l_orderkey * 8 + l_linenumber AS i, l_discount AS f FROM lineitem),
u AS (SELECT *, {_u(0, 5)} AS u0, {_u(1, 5)} AS u1, {_u(2, 5)} * {_BINS} AS y0, {_u(3, 5)} * {_BINS} AS y1 FROM g),
v AS (SELECT *, CASE WHEN u0 < {_GRAPHS[0]} THEN 0 ELSE 1 END AS graph FROM u),
c AS (SELECT *, CASE graph WHEN 0 THEN CASE WHEN u1 < 0.5 THEN 0 WHEN u1 < 0.75 THEN 1 ELSE 2 END ELSE CASE WHEN u1 < 0.125 THEN 0 WHEN u1 < 0.625 THEN 1 ELSE 2 END END AS channel FROM v),
e AS (SELECT c.*, e.e, e.p, floor(y0)::BIGINT AS b0, floor(y1)::BIGINT AS b1 FROM c JOIN (VALUES {", ".join(
    f"({g}, {c}, {p * q!r}::DOUBLE, {[float(x) for x in _edges(3 * g + c)]}::DOUBLE[])" for g, p in enumerate(_GRAPHS) for c, q in enumerate(_CHANNELS[g]))}) AS e(graph, channel, p, e) USING (graph, channel)),
w AS (SELECT *, e[b0 + 1] + (y0 - b0) * (e[b0 + 2] - e[b0 + 1]) AS x0, e[b1 + 1] + (y1 - b1) * (e[b1 + 2] - e[b1 + 1]) AS x1,
  {_BINS * _BINS} * (e[b0 + 2] - e[b0 + 1]) * (e[b1 + 2] - e[b1 + 1]) / p AS weight FROM e)"""


def _drawn(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_index"), F.col("l_discount").alias("f"))
    return nested_grid.draw(li, _grid(spark), 5)


@query(f"WITH {_DRAWN} SELECT i AS sample_index, graph::BIGINT AS graph, channel::BIGINT AS channel, round(x0, 9) AS x0, round(x1, 9) AS x1, round(weight, 9) AS weight FROM w")
def nested_grid_points(spark, sf_dir):
    """A point of a nested grid for each line item, with the weight of the whole way down."""
    d, c = F.col("discrete"), F.col("continuous")
    points = _drawn(spark, sf_dir).select("sample_index", d[0].alias("graph"), d[1].alias("channel"), c[0].alias("x0"), c[1].alias("x1"), "weight")
    return rounded(points, 9)


@query(f"""WITH {_DRAWN}, m AS (SELECT *, f * exp(-x0 - x1) * weight * (f * exp(-x0 - x1) * weight) AS mass FROM w),
a AS (SELECT '' AS path, -1 AS dim, graph::BIGINT AS bin, mass FROM m UNION ALL SELECT graph || '', -1, channel, mass FROM m
  UNION ALL SELECT graph || ',' || channel, 0, b0, mass FROM m UNION ALL SELECT graph || ',' || channel, 1, b1, mass FROM m)
SELECT path, dim, bin, round(sum(mass), 6) AS mass, count(*) AS n FROM a GROUP BY 1, 2, 3""")
def nested_grid_window(spark, sf_dir):
    """What a window of line items adds to every node and leaf, in one aggregate."""
    c = F.col("continuous")
    cells = nested_grid.window_cells(_drawn(spark, sf_dir), F.col("f") * F.exp(-c[0] - c[1]))
    return rounded(cells.select(F.array_join("path", ",").alias("path"), "dim", "bin", "mass", "n"))


_VALUES = """v AS (SELECT event_type, 1.0 + event_id % 3 AS w, event_id % 13 = 0 AS m, value AS linear, value + 1 AS spread,
  CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN NULL ELSE value - 50 END AS holes FROM events),
c AS (SELECT event_type, w, m, 'holes' AS name, CASE WHEN holes IS NULL OR isnan(holes) THEN NULL WHEN holes < -40 THEN 0 WHEN holes >= 60 THEN 11
    ELSE least(floor((holes + 40) / 100 * 10) + 1, 10) END AS bin FROM v
  UNION ALL SELECT event_type, w, m, 'linear', CASE WHEN linear < 10 THEN 0 WHEN linear >= 110 THEN 21 ELSE least(floor((linear - 10) / 100 * 20) + 1, 20) END FROM v
  UNION ALL SELECT event_type, w, m, 'spread', CASE WHEN spread < 2 THEN 0 WHEN spread >= 512 THEN 9 ELSE least(floor(log10(spread / 2) / log10(256) * 8) + 1, 8) END FROM v)"""


def _bundles(spark, sf_dir):
    k, v = F.col("event_id"), F.col("value")
    holes = F.when(k % 97 == 0, F.lit(float("nan"))).when(k % 89 == 0, F.lit(None)).otherwise(v - 50)
    three = [bundles.Histogram("linear", v, 10, 110, 20), bundles.Histogram("spread", v + 1, 2, 512, 8, log=True), bundles.Histogram("holes", holes, -40, 60, 10)]
    e = table(spark, sf_dir, "events").withColumn("batch_id", F.col("user_id") % 16)
    return bundles.merge(bundles.fill(e, ["event_type", "batch_id"], three, 1 + k % 3, k % 13 == 0), ["event_type"])


@query(f"""WITH {_VALUES} SELECT event_type, name, bin::INT AS bin, count(*) AS entries, CASE WHEN bin IS NULL THEN 0.0 ELSE round(sum(w), 6) END::DOUBLE AS weights,
  CASE WHEN bin IS NULL THEN 0.0 ELSE round(sum(w * w), 6) END::DOUBLE AS squares, (CASE WHEN bin IS NULL THEN 0 ELSE count(*) FILTER (m) END)::BIGINT AS mitigated FROM c GROUP BY event_type, name, bin""")
def histogram_bundle(spark, sf_dir):
    """Three histograms of events, filled in one pass for each batch and merged."""
    cells = bundles.opened(_bundles(spark, sf_dir), ["event_type"]).where("entries > 0")
    return rounded(cells.select("event_type", "name", "bin", *bundles.ARRAYS))


@query(f"""WITH {_VALUES}, n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT event_type, bin, count(*) AS entries, sum(w) / n AS a, sum(w * w) / n AS q, n FROM c JOIN n USING (event_type) WHERE name = 'spread' AND bin BETWEEN 1 AND 8 GROUP BY event_type, bin, n)
SELECT event_type, bin::INT AS bin, round(2 * power(256.0, (bin - 1) / 8.0), 6) AS start, round(2 * power(256.0, bin / 8.0), 6) AS stop, entries, round(a, 6) AS value, round(sqrt(greatest(q - a * a, 0) / n), 6) AS error FROM s""")
def histogram_bundle_bins(spark, sf_dir):
    """The logarithmic histogram of the bundle, per sample."""
    out = bundles.bins(_bundles(spark, sf_dir), ["event_type"]).where("name = 'spread' and entries > 0")
    return rounded(out.select("event_type", "bin", "start", "stop", "entries", "value", "error"))


@query("""WITH v AS (SELECT event_type, 1.0 + event_id % 3 AS w, least(floor((value - 10) / 100 * 4) + 1, 4)::INT AS bin FROM events WHERE value >= 10 AND value < 110),
n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), k AS (SELECT event_type, n, unnest([1, 2, 3, 4]) AS bin FROM n),
s AS (SELECT k.event_type, k.bin, k.n, coalesce(sum(w), 0) / k.n AS a, coalesce(sum(w * w), 0) / k.n AS q FROM k LEFT JOIN v ON v.event_type = k.event_type AND v.bin = k.bin GROUP BY 1, 2, 3),
t AS (SELECT event_type, bin, printf('  %.8e   %.8e   %.8e   %.8e', 10 + (bin - 1) * 25.0::DOUBLE, 10 + bin * 25.0::DOUBLE, round(a, 6), round(sqrt(greatest(q - a * a, 0) / n), 6)) AS line FROM s)
SELECT event_type, 'coarse' AS name, '##& xmin & xmax & central value & dy &' || chr(10) || chr(10) || '<histogram> 4 "coarse of events |X_AXIS@LIN |Y_AXIS@LOG |TYPE@HwU"' || chr(10) ||
  string_agg(regexp_replace(line, 'e([+-])0([0-9])', 'e\\1\\2', 'g'), chr(10) ORDER BY bin) || chr(10) || '<\\histogram>' || chr(10) AS block FROM t GROUP BY 1""")
def histogram_blocks(spark, sf_dir):
    """Histograms as blocks of text: head, axes and rows."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    states = bundles.fill(e, ["event_type"], [bundles.Histogram("coarse", F.col("value"), 10, 110, 4)], 1 + k % 3, F.lit(False))
    rows = rounded(bundles.bins(states, ["event_type"]))
    return panels.hwu_blocks(rows, ["event_type"], F.concat(F.col("name"), F.lit(" of events")), F.lit(False), F.lit(True))


@query(f"""WITH b AS (SELECT event_id AS batch_id, event_id + 11000033 AS seed, event_id % 7 AS n FROM events WHERE event_id % 5 = 0),
p AS (SELECT batch_id, unnest(range(n)) AS sample_index, seed FROM b), k AS (SELECT batch_id, sample_index, seed || '/' || sample_index AS i FROM p)
SELECT batch_id, sample_index, round({_u(0, "latent")}, 12) AS x0, round({_u(1, "latent")}, 12) AS x1, 1.0::DOUBLE AS weight FROM k""")
def latent_points(spark, sf_dir):
    """The points of latent batches that events describe, drawn by a table function from the rows of a table."""
    described = table(spark, sf_dir, "events").where("event_id % 5 = 0").select(F.col("event_id").alias("batch_id"), (F.col("event_id") % 7).alias("nr_samples"))
    return rounded(generate.draw_batches(generate.latent_batches(described, 11), 2), 12)


_ASKED = 3
_LEVELLED = """n AS (SELECT count(*) AS total FROM events), k AS (SELECT unnest([1, 2, 3]) AS request),
s AS (SELECT request, event_type, event_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY request, event_type) AS n, max(event_id) OVER (PARTITION BY request, event_type) AS last
  FROM events, k, n WHERE event_id < total * request // 3 WINDOW w AS (PARTITION BY request, event_type ORDER BY event_id)),
l AS (SELECT *, greatest(0, ceil(log2(n / 32)))::INT AS level FROM s), d AS (SELECT DISTINCT request, event_type, level, last FROM l),
a AS (SELECT l.*, d.level IS NOT NULL AND d.level = l.level AS append, d.last AS had FROM l LEFT JOIN d ON d.request = l.request - 1 AND d.event_type = l.event_type)"""


def _asked(spark, sf_dir):
    """Answers to a reader that asks after each third of the events: (request, answers)."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    total, cursors, out = e.count(), None, []
    for request in range(1, _ASKED + 1):
        found = pyramid.answer(e.where(F.col("event_id") < total * request // _ASKED), ["event_type"], "event_id", cursors, 32)
        cursors = pyramid.cursors_of(found, ["event_type"], cursors)
        out.append(found)
    return out


@query(f"""WITH {_LEVELLED} SELECT request::INT AS request, event_type, event_id, value, CASE WHEN append THEN 'append' ELSE 'replace' END AS mode, i % (1::BIGINT << level) <> 0 AS provisional,
  last || ':' || level AS cursor FROM a WHERE (i % (1::BIGINT << level) = 0 OR i = n - 1) AND (NOT append OR event_id > had)""")
def panel_deltas(spark, sf_dir):
    """What a reader of thinned series gets when it asks three times with its cursor."""
    answers = [a.select(F.lit(i).alias("request"), "*") for i, a in enumerate(_asked(spark, sf_dir), 1)]
    return answers[0].unionByName(answers[1]).unionByName(answers[2])


@query(f"""WITH {_LEVELLED} SELECT event_type, event_id, value, i % (1::BIGINT << level) <> 0 AS provisional FROM a WHERE request = 3 AND (i % (1::BIGINT << level) = 0 OR i = n - 1)""")
def panel_series(spark, sf_dir):
    """What the reader shows after the three answers: the whole series at its level."""
    shown = None
    for found in _asked(spark, sf_dir):
        shown = pyramid.applied(shown, found, ["event_type"])
    return shown


@query("""WITH s AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
l AS (SELECT *, greatest(0, ceil(log2(n / 256)))::INT AS top FROM s), x AS (SELECT *, unnest(range(top + 1)) AS level FROM l)
SELECT event_type, level::INT AS level, event_id, i // (1::BIGINT << level) AS place FROM x WHERE i % (1::BIGINT << level) = 0""")
def panel_pyramid(spark, sf_dir):
    """All levels of each series."""
    return pyramid.levels(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], "event_id")


@query("""WITH d AS (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS day, count(*) AS n, avg(l_discount) AS m, avg(l_discount * l_discount) AS q FROM lineitem GROUP BY 1, 2),
e AS (SELECT *, greatest(q - m * m, 0) / n AS v FROM d), w AS (SELECT *, 1 / v AS w FROM e WHERE v > 1e-12),
s AS (SELECT l_returnflag, count(*) AS windows, sum(w) AS s0, sum(w * m) AS s1, sum(w * m * m) AS s2 FROM w GROUP BY 1)
SELECT l_returnflag, windows, round(s1 / s0, 6) AS mean, round(1 / sqrt(s0), 8) AS error, round(greatest(s2 - s1 * s1 / s0, 0) / (windows - 1), 3) AS chi_sq FROM s""")
def window_convergence(spark, sf_dir):
    """Estimates of windows of a day as one, weighted by their variances, and chi-squared per degree of freedom."""
    states = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_shipdate").cast("date").alias("day")).agg(*observe.scalar_partial(F.col("l_discount"), F.lit(1.0)))
    e = observe.scalar_estimate()
    windows = observe.finalise(states, {"mean": e["mean"], "stderr": e["stderr"]})
    half = (F.dayofyear("day") % 4).alias("part")  # windows in four parts, merged afterwards
    parts = windows.groupBy("l_returnflag", half).agg(*observe.convergence_partial(F.col("mean"), F.col("stderr"), least=1e-6))
    merged = observe.merge(parts, ["l_returnflag"], observe.CONVERGENCE_STATE)
    out = observe.finalise(merged, observe.convergence_estimate())
    return out.select("l_returnflag", "windows", F.round("mean", 6).alias("mean"), F.round("error", 8).alias("error"), F.round("chi_sq", 3).alias("chi_sq"))
