"""Observables: mergeable aggregates of weighted values and what is read off them.

A partial state is one row of sums, so states of batches merge by summing again. Weights count by their absolute
value. Contributions that are not finite are counted apart and leave the sums alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.numeric import is_finite, ratio
from lumenfold.operators import scan

SCALAR_STATE = ("count", "sum_weighted_value", "sum_abs", "sum_sq", "nan_count")
COMPLEX_STATE = ("count", "real_sum", "imag_sum", "abs_sum", "abs_sq_sum", "real_sq_sum", "imag_sq_sum", "weight_sum", "nan_count")


def _sum_if(ok: Column, x: Column) -> Column:
    return F.coalesce(F.sum(F.when(ok, x)), F.lit(0.0))


def scalar_partial(value: Column, weight: Column) -> list[Column]:
    wv = value * F.abs(weight)
    ok = is_finite(wv) & is_finite(wv * wv)
    return [F.count_if(ok).alias("count"), _sum_if(ok, wv).alias("sum_weighted_value"), _sum_if(ok, F.abs(wv)).alias("sum_abs"),
            _sum_if(ok, wv * wv).alias("sum_sq"), F.count_if(~ok).alias("nan_count")]


def complex_partial(value: Column, weight: Column) -> list[Column]:
    w = F.abs(weight)
    re, im, size = value["re"] * w, value["im"] * w, F.hypot(value["re"], value["im"]) * w
    ok = is_finite(re) & is_finite(im) & is_finite(size) & is_finite(size * size) & is_finite(re * re) & is_finite(im * im) & is_finite(w)
    named = {"real_sum": re, "imag_sum": im, "abs_sum": size, "abs_sq_sum": size * size, "real_sq_sum": re * re, "imag_sq_sum": im * im, "weight_sum": w}
    return [F.count_if(ok).alias("count"), *[_sum_if(ok, x).alias(k) for k, x in named.items()], F.count_if(~ok).alias("nan_count")]


def merge(states: DataFrame, keys: Sequence[str], fields: Sequence[str] = SCALAR_STATE) -> DataFrame:
    """Partial states summed by ``keys``."""
    return states.groupBy(*keys).agg(*[F.sum(f).alias(f) for f in fields])


def _mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, total / n).otherwise(0.0)


def _variance(squares: Column, total: Column, n: Column) -> Column:
    mean = _mean(total, n)
    return F.when(n > 0, F.greatest(squares / n - mean * mean, F.lit(0.0))).otherwise(0.0)


def _stderr(squares: Column, total: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(_variance(squares, total, n) / n)).otherwise(0.0)


def scalar_estimate() -> dict[str, Column]:
    """mean, mean_abs, variance, stderr, signal_to_noise (mean_abs squared over the squared error) and rsd (variance over mean_abs squared)."""
    n, total, size, squares = (F.col(c) for c in SCALAR_STATE[:4])
    mean_abs, variance, error = _mean(size, n), _variance(squares, total, n), _stderr(squares, total, n)
    return {
        "mean": _mean(total, n), "mean_abs": mean_abs, "variance": variance, "stderr": error,
        "signal_to_noise": F.when(error > 0, mean_abs * mean_abs / (error * error)).otherwise(0.0),
        "rsd": ratio(variance, mean_abs * mean_abs),
    }


def complex_estimate() -> dict[str, Column]:
    """Means and errors of both parts and of the modulus; signal_to_noise and rsd are of the modulus."""
    c = F.col
    n = c("count")
    parts = {k: (c(f"{k}_sq_sum"), c(f"{k}_sum")) for k in ("real", "imag", "abs")}
    out = {f"{k}_mean": _mean(t, n) for k, (_, t) in parts.items()} | {f"{k}_stderr": _stderr(s, t, n) for k, (s, t) in parts.items()}
    out["abs_variance"] = _variance(*parts["abs"], n)
    size, error = out["abs_mean"], out["abs_stderr"]
    out["signal_to_noise"] = F.when(error > 0, size * size / (error * error)).otherwise(0.0)
    out["rsd"] = ratio(out["abs_variance"], size * size)
    return out


def finalise(states: DataFrame, estimate: dict[str, Column], digits: int | None = None) -> DataFrame:
    """States with their estimates."""
    return states.select("*", *[(F.round(x, digits) if digits is not None else x).alias(k) for k, x in estimate.items()])


CONVERGENCE_STATE = ("windows", "inverse_variance", "weighted_mean", "weighted_square")


def convergence_partial(mean: Column, error: Column, least: float = 0.0) -> list[Column]:
    """A mergeable state of window estimates, each weighted by its inverse variance; windows of no finite error above ``least`` are left out."""
    ok = is_finite(mean) & is_finite(error) & (error > least)
    w = 1 / (error * error)
    named = dict(zip(CONVERGENCE_STATE[1:], (w, w * mean, w * mean * mean)))
    return [F.count_if(ok).alias("windows"), *[_sum_if(ok, x).alias(k) for k, x in named.items()]]


def convergence_estimate() -> dict[str, Column]:
    """The windows' mean and its error, and chi-squared per degree of freedom; null where they say nothing."""
    n, s0, s1, s2 = (F.col(c) for c in CONVERGENCE_STATE)
    known = s0 > 0
    spread = F.greatest(s2 - s1 * s1 / s0, F.lit(0.0))
    return {"mean": F.when(known, s1 / s0), "error": F.when(known, 1 / F.sqrt(s0)), "chi_sq": F.when(known & (n > 1), spread / (n - 1))}


def pull(mean: Column, error: Column, target: Column) -> Column:
    """Deviations of an estimate from a known target."""
    return ratio(mean - target, error)


def full_scalar(evaluated: DataFrame) -> DataFrame:
    """Every point's weighted value in place: (sample_index, value, is_nan), 0 where it is not finite."""
    wv = F.col("value") * F.abs(F.col("weight"))
    return evaluated.select("sample_index", F.when(is_finite(wv), wv).otherwise(0.0).alias("value"), (~is_finite(wv)).alias("is_nan"))


def full_complex(evaluated: DataFrame) -> DataFrame:
    w = F.abs(F.col("weight"))
    re, im = F.col("value")["re"] * w, F.col("value")["im"] * w
    ok = is_finite(re) & is_finite(im)
    return evaluated.select("sample_index", F.when(ok, re).otherwise(0.0).alias("re"), F.when(ok, im).otherwise(0.0).alias("im"), (~ok).alias("is_nan"))


def full_merge(parts: DataFrame, batch: str = "batch_id", index: str = "sample_index") -> DataFrame:
    """Full observables of batches one after another: each batch's indices follow those of the batches before it.

    Offsets are running sums of the batches' sizes, in ranges of batches.
    """
    sizes = parts.groupBy(batch).agg(F.count("*").alias("_n")).select(batch, "_n", F.col("_n").alias("_upto"))
    offsets = scan.running_sums(sizes, [batch], ["_upto"]).select(batch, (F.col("_upto") - F.col("_n")).alias("_offset"))
    return parts.join(offsets, batch).withColumn("position", F.col("_offset") + F.col(index)).drop("_offset")


def histogram_bins(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin of a value: 1..bins, 0 below, bins + 1 from ``high`` on; null for NaN."""
    inside = F.floor((value - low) / ((high - low) / bins)).cast("int") + 1
    return F.when(F.isnan(value) | value.isNull(), F.lit(None)).when(value < low, 0).when(value >= high, bins + 1).otherwise(F.least(inside, F.lit(bins)))


def fill_histogram(rows: DataFrame, keys: Sequence[str], value: Column, weight: Column, low: float, high: float, bins: int) -> DataFrame:
    """(keys, bin, entry_count, sum_weights, sum_weights_squared); under- and overflow are bins 0 and bins + 1."""
    placed = rows.select(*keys, histogram_bins(value, low, high, bins).alias("bin"), weight.cast("double").alias("_w")).where("bin is not null")
    return placed.groupBy(*keys, "bin").agg(
        F.count("*").alias("entry_count"), F.sum("_w").alias("sum_weights"), F.sum(F.col("_w") * F.col("_w")).alias("sum_weights_squared")
    )


HISTOGRAM_STATE = ("entry_count", "sum_weights", "sum_weights_squared")


def histogram_estimate(samples: Column) -> dict[str, Column]:
    """A bin's average weight per sample and its error, of a histogram of so many samples."""
    average = ratio(F.col("sum_weights"), samples)
    spread = F.greatest(ratio(F.col("sum_weights_squared"), samples) - average * average, F.lit(0.0))
    return {"value": average, "error": F.when(samples > 0, F.sqrt(spread / samples)).otherwise(0.0)}


#: What stays of each kind of state: in full to go on with, persistent for histories, a digest for lists.
PERSISTENT = {"scalar": SCALAR_STATE, "complex": COMPLEX_STATE, "full_scalar": ("processed",), "full_complex": ("processed",)}


def persistent(states: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """The compact form of states: sums as they are, of full fields only how many points they have."""
    if kind in ("full_scalar", "full_complex"):
        return states.groupBy(*keys).agg(F.count("*").alias("processed"))
    return states.select(*keys, *PERSISTENT[kind])


def digest(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, count, nan_count, mean, stderr) of scalar states."""
    e = scalar_estimate()
    return finalise(states, {"mean": e["mean"], "stderr": e["stderr"]}).select(*keys, "count", "nan_count", "mean", "stderr")


def not_json_safe(values: Column) -> Column:
    """Whether an array holds a number that JSON cannot."""
    return F.exists(values, lambda x: ~is_finite(x))
