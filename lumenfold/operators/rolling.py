"""Metrics over time: exponential averages, rates, ratios and breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.numeric import is_finite
from lumenfold.operators import scan
from lumenfold.plans.control import EWMA_ALPHA


def ewma_step(mean: float | None, variance: float, x: float, alpha: float = EWMA_ALPHA) -> tuple[float, float]:
    """One observation: the first sets the mean; later ones move mean and variance."""
    if mean is None:
        return x, 0.0
    delta = x - mean
    return mean + alpha * delta, max(0.0, (1 - alpha) * (variance + alpha * delta * delta))


def ewma(rows: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, alpha: float = EWMA_ALPHA, target: int = scan.TARGET) -> DataFrame:
    """(keys, mean, variance, n) after all observations in order; those negative or not finite are passed over."""
    return _ewma_of(ewma_states(rows.where(_observed(x)), keys, order, x, alpha, target), keys)


def ewma_states(rows: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, alpha: float = EWMA_ALPHA, target: int = scan.TARGET) -> DataFrame:
    """(keys, state): what a key's observations in order do to a mean and variance.

    A stretch of observations takes a mean m and variance v to ``a m + b`` and ``a v + c0 + c1 m + c2 m^2``. Such maps
    compose to one of the same form, so a key's stretches are scanned apart and joined in any grouping. A stretch of
    values that are passed over changes nothing.
    """
    keep = 1 - alpha

    def fold(xs: Column) -> Column:
        good = F.filter(xs, lambda e: e.isNotNull())
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.get(good, F.lit(0)).alias("first"), F.lit(1.0).alias("a"), *[F.lit(0.0).alias(k) for k in ("b", "c0", "c1", "c2")])

        def step(s: Column, e: Column) -> Column:
            d = e - s["b"]
            return F.struct(
                (s["n"] + 1).alias("n"), s["first"].alias("first"), (keep * s["a"]).alias("a"), (s["b"] + alpha * d).alias("b"),
                (keep * (s["c0"] + alpha * d * d)).alias("c0"), (keep * (s["c1"] - 2 * alpha * d * s["a"])).alias("c1"), (keep * (s["c2"] + alpha * s["a"] * s["a"])).alias("c2"),
            )

        return F.aggregate(good, start, step)

    seen = rows.withColumn(x, F.when(_observed(x), F.col(x).cast("double")))
    return scan.composed(seen, keys, order, x, fold, _then, target)


def ewma_after(states: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, mean, variance, n) after the stretches (keys, ``order``, state), one after the other; ``order`` numbers them from 0 on."""
    most = states.agg(F.max(order)).first()[0] or 0
    return _ewma_of(scan.joined(states.withColumnRenamed(order, "_i"), keys, _then, most + 1), keys)


def _observed(x: str) -> Column:
    return is_finite(F.col(x)) & (F.col(x) >= 0)


def _then(f: Column, g: Column) -> Column:
    return F.struct(
        (f["n"] + g["n"]).alias("n"), F.coalesce(f["first"], g["first"]).alias("first"), (g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"),
        (g["a"] * f["c0"] + g["c0"] + g["c1"] * f["b"] + g["c2"] * f["b"] * f["b"]).alias("c0"),
        (g["a"] * f["c1"] + g["c1"] * f["a"] + 2 * g["c2"] * f["a"] * f["b"]).alias("c1"), (g["a"] * f["c2"] + g["c2"] * f["a"] * f["a"]).alias("c2"),
    )


def _ewma_of(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    s, m = F.col("state"), F.col("state")["first"]  # the first observation sets the mean
    variance = F.greatest(F.lit(0.0), s["c0"] + s["c1"] * m + s["c2"] * m * m)
    return states.select(*keys, (s["a"] * m + s["b"]).alias("mean"), variance.alias("variance"), s["n"].alias("n"))


def throughput(rows: DataFrame, keys: Sequence[str], order: Sequence[str], done: str, ts: str) -> DataFrame:
    """Completed samples per second since the row before; 0 where the counter or the clock went back, null at first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    rate = F.try_divide((F.col(done) - F.lag(done).over(w)).cast("double"), seconds)
    return rows.withColumn("throughput", F.greatest(rate, F.lit(0.0)))


def breakdown(rows: DataFrame, keys: Sequence[str], segments: dict[str, Column]) -> DataFrame:
    """(keys, segment, ms, total_ms): the positive finite segments of each row and their sum."""
    cells = F.array(*[F.struct(F.lit(k).alias("segment"), v.cast("double").alias("ms")) for k, v in segments.items()])
    cells = F.filter(cells, lambda s: is_finite(s["ms"]) & (s["ms"] > 0))
    listed = rows.withColumn("_s", cells).withColumn("total_ms", F.aggregate("_s", F.lit(0.0), lambda t, s: t + s["ms"]))
    return listed.select(*keys, "total_ms", F.explode("_s").alias("s")).select(*keys, "s.segment", "s.ms", "total_ms")


def fleet_summary(history: DataFrame, keys: Sequence[str], worker: str, order: Sequence[Column], metrics: Sequence[str]) -> DataFrame:
    """Means over workers of each one's latest metrics; a missing metric counts as 0."""
    n = F.row_number().over(Window.partitionBy(*keys, worker).orderBy(*order))
    latest = history.withColumn("_n", n).where("_n = 1")
    return latest.groupBy(*keys).agg(F.count("*").alias("workers"), *[F.avg(F.coalesce(F.col(m), F.lit(0.0))).alias(f"avg_{m}") for m in metrics])
