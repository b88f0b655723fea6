"""Series, images and histograms as the tables that a display draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.display import flat_room
from lumenfold.functions.numeric import coprime_stride, is_finite
from lumenfold.operators import scan

BUDGET = 256


def merge_series(old: DataFrame, new: DataFrame, keys: Sequence[str] = (), x: str = "x") -> DataFrame:
    """Two series as one: where both have a point at x, the new one stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*keys, x).orderBy(F.desc("_new")))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_new")


def downsample(series: DataFrame, keys: Sequence[str], order: Sequence[str], budget: int = BUDGET, target: int = scan.TARGET) -> DataFrame:
    """Every 2^L-th point of a series and its last, for the smallest L that fits the budget; short series stay whole."""
    indexed = scan.positions(series, keys, order, "_i", "_n", target)
    step = F.pow(F.lit(2.0), downsample_level(F.col("_n"), budget)).cast("bigint")
    kept = indexed.where((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n") - 1))
    return kept.drop("_i", "_n")


def downsample_level(points: Column, budget: int = BUDGET) -> Column:
    """How often the number of points must be halved, rounding up, to fit the budget."""
    return F.greatest(F.ceil(F.log2(points / budget)), F.lit(0)).cast("int")


def pivot_series(rows: DataFrame, x: str, series: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per x with a column per series; null where a series has no point."""
    return rows.groupBy(x).pivot(series, list(names)).agg(F.first(value))


def unpermute(values: DataFrame, n: int, columns: Sequence[str]) -> DataFrame:
    """Values by visit (sample_index) put at their pixels 0..n-1; NaN where none came."""
    pixel = ((F.col("sample_index") * coprime_stride(n)) % n).alias("pixel") if n > 1 else F.col("sample_index").alias("pixel")
    placed = values.select(pixel, *columns)
    every = values.sparkSession.range(n).withColumnRenamed("id", "pixel")
    return every.join(placed, "pixel", "left").select("pixel", *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in columns])


def value_range(rows: DataFrame, value: Column, mode: str) -> DataFrame:
    """(low, high) of the finite values for a colour scale: ``symmetric`` about 0 or ``min_max``; never of no width, (0, 1) without values."""
    v = F.when(is_finite(value), value)
    one = rows.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.max(F.abs(v)).alias("most"))
    if mode == "symmetric":
        most = F.greatest("most", F.when(F.col("most").isNotNull(), F.lit(1e-12)))
        return one.select(F.coalesce(-most, F.lit(0.0)).alias("low"), F.coalesce(most, F.lit(1.0)).alias("high"))
    pad = F.when(F.col("hi") > F.col("lo"), 0.0).otherwise(flat_room(F.col("lo"), 0.1))
    return one.select(F.coalesce(F.col("lo") - pad, F.lit(0.0)).alias("low"), F.coalesce(F.col("hi") + pad, F.lit(1.0)).alias("high"))


def histogram_steps(bins: DataFrame, log_y: bool = False, epsilon: float = 2.220446049250313e-16) -> DataFrame:
    """Two corners per bin (start, stop, value, error), its centre and its error relative to the value."""
    y = F.greatest(F.col("value"), F.lit(epsilon)) if log_y else F.col("value")
    corners = F.explode(F.array(F.struct(F.lit(0).alias("corner"), F.col("start").alias("x")), F.struct(F.lit(1).alias("corner"), F.col("stop").alias("x")))).alias("c")
    keep = [c for c in bins.columns if c not in ("x", "y")]
    out = bins.select(*keep, ((F.col("start") + F.col("stop")) / 2).alias("centre"), y.alias("y"), F.abs(F.try_divide(F.col("error"), F.col("value"))).alias("relative_error"), corners)
    return out.select(*keep, "centre", "y", "relative_error", "c.corner", "c.x")


def exponential(x: Column) -> Column:
    """Eight digits and an exponent without leading zeros; a fixed zero for what is not finite."""
    text = F.format_string("%.8e", x.cast("double"))
    return F.when(is_finite(x), F.regexp_replace(text, "e([+-])0([0-9])$", "e$1$2")).otherwise("0.00000000e+00")


def hwu_lines(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a plain-text histogram: start, stop, value and error."""
    return bins.select(*keys, F.concat(F.lit("  "), F.concat_ws("   ", *[exponential(F.col(c)) for c in ("start", "stop", "value", "error")])).alias("line"))


def hwu_blocks(bins: DataFrame, keys: Sequence[str], title: Column, log_x: Column, log_y: Column, kind: str = "HwU") -> DataFrame:
    """(keys, name, block): each histogram (keys, name, bin, start, ...) as text: a head, its axes, and a line per bin in order."""
    lines = hwu_lines(bins.withColumns({"_title": title, "_x": log_x, "_y": log_y}), [*keys, "name", "bin", "_title", "_x", "_y"])
    one = lines.groupBy(*keys, "name", "_title", "_x", "_y").agg(F.array_sort(F.collect_list(F.struct("bin", "line"))).alias("lines"))  # as many as bins
    axis = lambda c: F.when(F.col(c), "LOG").otherwise("LIN")
    about = F.concat(F.col("_title"), F.lit(" |X_AXIS@"), axis("_x"), F.lit(" |Y_AXIS@"), axis("_y"), F.lit(f" |TYPE@{kind}"))
    head = F.concat(F.lit("<histogram> "), F.size("lines").cast("string"), F.lit(' "'), about, F.lit('"'))
    parts = F.concat(F.array(F.lit("##& xmin & xmax & central value & dy &"), F.lit(""), head), F.transform("lines", lambda e: e["line"]), F.array(F.lit("<\\histogram>"), F.lit("")))
    return one.select(*keys, "name", F.array_join(parts, "\n").alias("block"))


def write_blocks(blocks: DataFrame, key: str, folder: str) -> None:
    """One text file for each key with its blocks in the order of their names."""
    blocks.repartition(key).sortWithinPartitions(key, "name").select(key, "block").write.mode("overwrite").partitionBy(key).text(folder)
