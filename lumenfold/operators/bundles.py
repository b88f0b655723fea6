"""Bundles of named histograms as mergeable states: a map from each name to arrays over its bins.

Array element 0 is the underflow, the last one the overflow. Bins are even, or even in the logarithm; values that are NaN,
null or (on a logarithmic axis) not positive are counted apart. A fill may be marked as mitigated, which is counted too.
Bundles of batches merge element by element, so any batching gives the same bundle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARRAYS = ("entries", "weights", "squares", "mitigated")


@dataclass(frozen=True)
class Histogram:
    name: str
    value: Column
    low: float
    high: float
    bins: int
    log: bool = False

    def __post_init__(self):
        if self.bins < 1 or not self.low < self.high or (self.log and self.low <= 0):
            raise ValueError(f"histogram {self.name!r} has no such axis")

    def edges(self) -> list[float]:
        if self.log:
            return [self.low * (self.high / self.low) ** (i / self.bins) for i in range(self.bins + 1)]
        return [self.low + (self.high - self.low) * i / self.bins for i in range(self.bins + 1)]

    def bin(self) -> Column:
        """0 below, bins + 1 from the upper end on, null where the value is counted apart."""
        v = self.value.cast("double")
        share = F.log10(F.when(v > 0, v) / self.low) / math.log10(self.high / self.low) if self.log else (v - self.low) / (self.high - self.low)
        inside = F.least(F.floor(share * self.bins) + 1, F.lit(self.bins))
        placed = F.when(v < self.low, 0).when(v >= self.high, self.bins + 1).otherwise(inside)
        apart = v.isNull() | F.isnan(v) | ((v <= 0) if self.log else F.lit(False))
        return F.when(~apart, placed).cast("int")


def fill(rows: DataFrame, keys: Sequence[str], histograms: Sequence[Histogram], weight: Column, mitigated: Column) -> DataFrame:
    """(keys, samples, bundle) of all rows of each key, for all histograms in one pass."""
    cells = F.array(*[F.struct(F.lit(h.name).alias("name"), h.bin().alias("bin")) for h in histograms])
    w = weight.cast("double")
    flat = rows.select(*keys, w.alias("w"), F.coalesce(mitigated, F.lit(False)).cast("bigint").alias("m"), F.explode(cells).alias("c")).select(*keys, "w", "m", "c.*")
    sums = flat.groupBy(*keys, "name", "bin").agg(
        F.count("*").alias("entries"), F.sum("w").alias("weights"), F.sum(F.col("w") * F.col("w")).alias("squares"), F.sum("m").alias("mitigated")
    )
    axes = F.create_map(*[x for h in histograms for x in (F.lit(h.name), F.array(*[F.lit(float(e)) for e in h.edges()]))])
    counted = rows.groupBy(*keys).agg(F.count("*").alias("samples"))
    return counted.join(_assembled(sums.withColumn("edges", axes[F.col("name")]), keys), list(keys), "left").select(*keys, "samples", F.coalesce("bundle", _none()).alias("bundle"))


def _none() -> Column:
    return F.create_map().cast(BUNDLE)


_HISTOGRAM = "struct<edges:array<double>,entries:array<bigint>,weights:array<double>,squares:array<double>,mitigated:array<bigint>,nan:bigint>"
BUNDLE = f"map<string,{_HISTOGRAM}>"


def _assembled(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, bundle) from sums by (keys, name, edges, bin); a histogram's list has as many elements as it has bins."""
    own = F.collect_list(F.struct("bin", *ARRAYS)).alias("cells")
    listed = sums.groupBy(*keys, "name", "edges").agg(own)
    by_bin = F.map_from_entries(F.transform(F.filter("cells", lambda c: c["bin"].isNotNull()), lambda c: F.struct(c["bin"], c)))
    listed = listed.withColumn("by_bin", by_bin)
    places = F.sequence(F.lit(0), F.size("edges"))
    zero = {"entries": F.lit(0).cast("bigint"), "mitigated": F.lit(0).cast("bigint")}
    array = lambda a: F.transform(places, lambda i: F.coalesce(F.try_element_at("by_bin", i)[a], zero.get(a, F.lit(0.0)))).alias(a)
    arrays = [array(a) for a in ARRAYS]
    nan = F.aggregate(F.filter("cells", lambda c: c["bin"].isNull()), F.lit(0).cast("bigint"), lambda s, c: s + c["entries"])
    one = listed.select(*keys, "name", F.struct("edges", *arrays, nan.alias("nan")).cast(_HISTOGRAM).alias("histogram"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "histogram")))).alias("bundle"))


def opened(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, name, edges, bin, entries, weights, squares, mitigated): a row per bin, with a null bin for what is counted apart."""
    named = states.select(*keys, F.explode("bundle").alias("name", "h"))
    cell = lambda i: F.struct(i.alias("bin"), *[F.element_at(F.col("h")[a], i + 1).alias(a) for a in ARRAYS])
    cells = F.transform(F.sequence(F.lit(0), F.size("h.edges")), cell)
    zero = [F.lit(0.0).alias("weights"), F.lit(0.0).alias("squares"), F.lit(0).cast("bigint").alias("mitigated")]
    apart = F.array(F.struct(F.lit(None).cast("int").alias("bin"), F.col("h.nan").alias("entries"), *zero))
    return named.select(*keys, "name", F.col("h.edges").alias("edges"), F.explode(F.concat(cells, apart)).alias("c")).select(*keys, "name", "edges", "c.*")


def merge(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, samples, bundle) over batches. An empty bundle adopts the others; bundles of other axes are refused."""
    cells = opened(states, keys)
    axes = cells.groupBy(*keys, "name").agg(F.min("edges").alias("edges"), F.max("edges").alias("other"))
    same = F.when(F.col("edges") == F.col("other"), F.col("edges")).otherwise(F.raise_error(F.concat(F.lit("histograms of other axes: "), "name")))
    sums = cells.groupBy(*keys, "name", "bin").agg(*[F.sum(a).alias(a) for a in ARRAYS])
    merged = _assembled(sums.join(axes.select(*keys, "name", same.alias("edges")), [*keys, "name"]), keys)
    samples = states.groupBy(*keys).agg(F.sum("samples").alias("samples"))
    return samples.join(merged, list(keys), "left").select(*keys, "samples", F.coalesce("bundle", _none()).alias("bundle"))


def bins(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, name, bin, start, stop, entries, mitigated, value, error): the bins in range, per sample."""
    inside = opened(states.drop("samples"), keys).where("bin between 1 and size(edges) - 1").join(states.select(*keys, "samples"), list(keys))
    average = F.col("weights") / F.col("samples")
    spread = F.greatest(F.col("squares") / F.col("samples") - average * average, F.lit(0.0))
    at = lambda i: F.element_at("edges", F.col("bin") + i)
    return inside.select(*keys, "name", "bin", at(0).alias("start"), at(1).alias("stop"), "entries", "mitigated", average.alias("value"), F.sqrt(spread / F.col("samples")).alias("error"))


def primary(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, histograms, name): how many histograms a bundle has, and the first by name."""
    return states.select(*keys, F.size("bundle").alias("histograms"), F.array_min(F.map_keys("bundle")).alias("name"))
