"""Series, images, histograms and labels as displays need them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import display
from lumenfold.functions.numeric import is_finite
from lumenfold.operators import panels
from lumenfold.queries.registry import query, rounded, table


@query("""WITH o AS (SELECT event_id AS x, value AS y FROM events WHERE event_type <> 'error'), n AS (SELECT event_id AS x, value * 2 AS y FROM events WHERE event_type <> 'view')
SELECT coalesce(n.x, o.x) AS x, coalesce(n.y, o.y) AS y FROM o FULL JOIN n ON n.x = o.x""")
def series_merge(spark, sf_dir):
    """Two whole series that overlap in part: the newer one's points replace the older one's at the same x."""
    e = table(spark, sf_dir, "events")
    old = e.where("event_type <> 'error'").select(F.col("event_id").alias("x"), F.col("value").alias("y"))
    new = e.where("event_type <> 'view'").select(F.col("event_id").alias("x"), (F.col("value") * 2).alias("y"))
    return panels.merge_series(old, new)


@query("""WITH s AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
l AS (SELECT *, (1::BIGINT << greatest(0, ceil(log2(n / 256)))::INT) AS step FROM s) SELECT event_type, event_id, value FROM l WHERE i % step = 0 OR i = n - 1""")
def series_downsample(spark, sf_dir):
    return panels.downsample(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"]).select("event_type", "event_id", "value")


@query("""SELECT user_id, min(value) FILTER (event_type = 'click') AS click, min(value) FILTER (event_type = 'view') AS view, min(value) FILTER (event_type = 'error') AS error
FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY user_id""")
def series_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type in ('click', 'view', 'error')").groupBy("user_id", "event_type").agg(F.min("value").alias("v"))
    return panels.pivot_series(rows, "user_id", "event_type", "v", ["click", "view", "error"])


_TURN = "(n + h / 60.0) - 6 * floor((n + h / 60.0) / 6)"


@query(f"""WITH z AS (SELECT event_id, value - 50 AS re, event_id % 100 - 50.0 AS im FROM events), m AS (SELECT max(sqrt(re * re + im * im)) AS top FROM z),
a AS (SELECT event_id, degrees(atan2(im, re)) + 180 AS h, least(1.0, sqrt(sqrt(re * re + im * im) / top)) AS v FROM z, m),
c AS (SELECT event_id, n, round((v - v * greatest(0.0, least({_TURN}, 4 - ({_TURN}), 1.0))) * 255)::INT AS x FROM a, (SELECT unnest([5, 3, 1]) AS n))
SELECT event_id, max(x) FILTER (n = 5) AS red, max(x) FILTER (n = 3) AS green, max(x) FILTER (n = 1) AS blue FROM c GROUP BY 1""")
def image_colour(spark, sf_dir):
    z = table(spark, sf_dir, "events").select("event_id", (F.col("value") - 50).alias("re"), (F.col("event_id") % 100 - 50).cast("double").alias("im"))
    top = z.agg(F.max(F.hypot("re", "im")).alias("top"))
    rgb = display.phase_colour(F.col("re"), F.col("im"), F.col("top"))
    return z.join(F.broadcast(top), how="inner").select("event_id", *[c.alias(n) for c, n in zip(rgb, ("red", "green", "blue"))])  # one row


@query("""SELECT event_id, round(255 * t)::INT AS red, round(200 * (1 - 2 * abs(t - 0.5)))::INT AS green, round(255 * (1 - t))::INT AS blue
FROM (SELECT event_id, (event_id % 64) / 64.0 AS t FROM events)""")
def scalar_ramp(spark, sf_dir):
    rgb = display.ramp_colour((F.col("event_id") % 64) / 64.0)
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for c, n in zip(rgb, ("red", "green", "blue"))])


@query("""WITH v AS (SELECT value - 50 AS v, CASE WHEN event_id % 2 = 0 THEN 5.0 END AS flat, CASE WHEN event_id % 2 = 0 THEN 0.0 END AS zero FROM events)
SELECT -max(abs(v)) AS low, max(abs(v)) AS high, 'symmetric' AS mode FROM v UNION ALL SELECT min(v), max(v), 'min_max' FROM v
UNION ALL SELECT min(flat) * 0.9, max(flat) * 1.1, 'flat' FROM v UNION ALL SELECT min(zero) - 1, max(zero) + 1, 'zero' FROM v
UNION ALL SELECT count(v) * 0.0, count(v) * 0.0 + 1, 'none' FROM v""")
def heatmap_scale(spark, sf_dir):
    """Colour scales of a field, of a flat one, of one that is 0 throughout, and of one without a finite value."""
    e = table(spark, sf_dir, "events")
    half = lambda x: F.when(F.col("event_id") % 2 == 0, F.lit(x)).otherwise(F.lit(float("nan")))
    whole = F.col("value") - 50
    scales = [(whole, "symmetric", "symmetric"), (whole, "min_max", "min_max"), (half(5.0), "min_max", "flat"), (half(0.0), "min_max", "zero"), (half(float("inf")), "symmetric", "none")]
    found = [rounded(panels.value_range(e, v, how)).withColumn("mode", F.lit(name)) for v, how, name in scales]
    return reduce(DataFrame.unionByName, found)


@query("""WITH v AS (SELECT event_id % 5 AS series, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN 0.0 WHEN 2 THEN -5.0 WHEN 3 THEN 'nan'::DOUBLE ELSE value / 10 END AS v FROM events),
g AS (SELECT series, min(v) FILTER (isfinite(v)) AS lo, max(v) FILTER (isfinite(v)) AS hi FROM v GROUP BY 1),
r AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) * 0.08 WHEN lo = 0 THEN 1.0 ELSE abs(lo) * 0.1 END AS room FROM g)
SELECT series, round(lo - room, 6) AS low, round(hi + room, 6) AS high FROM r""")
def axis_fit(spark, sf_dir):
    """Axis limits of series: spread, 0 throughout, flat, and without a finite value."""
    k = F.col("event_id") % 5
    v = F.when(k == 0, F.col("value")).when(k == 1, 0.0).when(k == 2, -5.0).when(k == 3, F.lit(float("nan"))).otherwise(F.col("value") / 10)
    finite = F.when(is_finite(v), v)
    one = table(spark, sf_dir, "events").groupBy(k.alias("series")).agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    low, high = display.padded(F.col("lo"), F.col("hi"))
    return rounded(one.select("series", low.alias("low"), high.alias("high")))


@query("""SELECT event_id, round(CASE WHEN event_id % 9 = 0 THEN event_id % 7 ELSE -2 + (value + 1 + 2) / 7 * (event_id % 7 + 0.5) END, 4)::DOUBLE AS x FROM events""")
def cell_centres(spark, sf_dir):
    """The centre of a cell of each event's range; the plain index where the range has no end."""
    high = F.when(F.col("event_id") % 9 == 0, F.lit(float("inf"))).otherwise(F.col("value") + 1)
    x = display.cell_centre(F.col("event_id") % 7, F.lit(-2.0), high, F.lit(7))
    return table(spark, sf_dir, "events").select("event_id", F.round(x, 4).alias("x"))


_HISTOGRAM = "h AS (SELECT floor(value / 10)::BIGINT AS bin, count(*)::DOUBLE AS value, sqrt(count(*)) AS error FROM events WHERE value < 400 GROUP BY 1)"


def _histogram(spark, sf_dir):
    h = table(spark, sf_dir, "events").where("value < 400").groupBy(F.floor(F.col("value") / 10).alias("bin")).agg(F.count("*").cast("double").alias("value"))
    return h.select("bin", (F.col("bin") * 10.0).alias("start"), (F.col("bin") * 10.0 + 10).alias("stop"), "value", F.sqrt("value").alias("error"))


@query(f"""WITH {_HISTOGRAM} SELECT bin, corner::INT AS corner, bin * 10.0::DOUBLE + 10 * corner AS x, bin * 10.0::DOUBLE + 5 AS centre, value AS y, round(error / value, 9) AS relative_error
FROM h, (SELECT unnest([0, 1]) AS corner)""")
def histogram_render(spark, sf_dir):
    out = panels.histogram_steps(_histogram(spark, sf_dir), log_y=True)
    return out.select("bin", "corner", "x", "centre", "y", F.round("relative_error", 9).alias("relative_error"))


@query(f"""WITH {_HISTOGRAM}, t AS (SELECT bin, printf('  %.8e   %.8e   %.8e   %.8e', bin * 10.0::DOUBLE, bin * 10.0::DOUBLE + 10, value, error) AS line FROM h)
SELECT bin, regexp_replace(line, 'e([+-])0([0-9])', 'e\\1\\2', 'g') AS line FROM t""")
def hwu_export(spark, sf_dir):
    return panels.hwu_lines(_histogram(spark, sf_dir), ["bin"])


@query("""SELECT event_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.2f KiB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.2f MiB', b / 1048576.0)
  ELSE printf('%.2f GiB', b / 1073741824.0) END AS size FROM (SELECT event_id, (event_id * event_id * 512 + event_id)::BIGINT AS b FROM events)""")
def human_sizes(spark, sf_dir):
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", display.human_bytes(i * i * 512 + i).alias("size"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM part")
def title_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", display.title_label(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("label"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.grid') IS NOT NULL AS has_grid FROM events")
def json_params(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object("props", "$.grid").isNotNull().alias("has_grid"))


_CONFIG = """'{"kind": "k' || user_id || '", "grid": {"bins": ' || event_id || ', "rates": [1, ' || user_id || ']}, "seed": null, "queue": {"buffer": {"size": ' || user_id || '}}}'"""


@query(f"""WITH c AS (SELECT event_id, CAST({_CONFIG} AS JSON) AS c FROM events), l AS (SELECT event_id, unnest(['kind', 'grid.bins', 'grid.rates', 'seed', 'queue.buffer.size']) AS key, c FROM c)
SELECT event_id, key, CASE key WHEN 'grid.rates' THEN '[' || array_to_string(json_extract_string(c, '$.grid.rates[*]'), ', ') || ']' WHEN 'seed' THEN 'null'
  ELSE json_extract_string(c, '$.' || key) END AS value FROM l""")
def json_flatten(spark, sf_dir):
    """A column of nested configurations as dotted keys and written values."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_CONFIG).alias("config"))
    return display.flatten_json_column(e, "config").select("event_id", "key", "value")


@query(f"""WITH c AS (SELECT event_id, CAST({_CONFIG} AS JSON) AS c FROM events WHERE event_id % 4 < 3)
SELECT event_id, 'present' AS size, 'null' AS seed, 'missing' AS colour FROM c UNION ALL SELECT event_id, 'missing', 'missing', 'missing' FROM events WHERE event_id % 4 = 3 AND event_id % 8 < 4
UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_id % 8 = 7""")
def json_presence(spark, sf_dir):
    """Whether a configuration has a key: present, there but null, missing, or unknown as it is no JSON."""
    k = F.col("event_id")
    config = F.when(k % 8 == 7, "{not json").when(k % 4 == 3, "{}").otherwise(F.expr(_CONFIG))
    has = {"size": "$.queue.buffer.size", "seed": "$.seed", "colour": "$.queue.colour"}
    return table(spark, sf_dir, "events").select("event_id", *[display.presence(config, path).alias(name) for name, path in has.items()])


@query("""WITH d AS (SELECT l_orderkey AS k, count(*) AS n, (sum(l_quantity) - 60) * 17 AS m, 3.0 * count(*) AS e FROM lineitem GROUP BY 1), s AS (SELECT *, greatest(abs(m), e) AS big FROM d),
p AS (SELECT *, floor(log10(big))::INT AS k10, e / power(10.0, floor(log10(big))) AS es FROM s), q AS (SELECT *, greatest(1 - floor(log10(es))::INT, 0) AS digits FROM p)
SELECT k, '(' || CASE digits WHEN 0 THEN printf('%.0f', m / power(10.0, k10)) WHEN 1 THEN printf('%.1f', m / power(10.0, k10)) WHEN 2 THEN printf('%.2f', m / power(10.0, k10))
  WHEN 3 THEN printf('%.3f', m / power(10.0, k10)) ELSE printf('%.4f', m / power(10.0, k10)) END || ' +- ' || CASE digits WHEN 0 THEN printf('%.0f', es) WHEN 1 THEN printf('%.1f', es)
  WHEN 2 THEN printf('%.2f', es) WHEN 3 THEN printf('%.3f', es) ELSE printf('%.4f', es) END || ') x 10^' || k10 AS text FROM q""")
def format_estimates(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(((F.sum("l_quantity") - 60) * 17).alias("m"), (3.0 * F.count("*")).alias("e"))
    return d.select("k", display.estimate_with_error(F.col("m"), F.col("e")).alias("text"))


@query("SELECT event_id, 'real' AS series, value AS y FROM events UNION ALL SELECT event_id, 'imag', value * 2 FROM events")
def line_components(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("real"), (F.col("value") * 2).alias("imag"))
    return rows.unpivot("event_id", ["real", "imag"], "series", "y")
