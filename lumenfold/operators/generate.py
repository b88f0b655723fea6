"""Point generators. A point is a row (sample_index, continuous, discrete, weight); nothing depends on partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lumenfold.functions.numeric import linspace, permuted, uniform
from lumenfold.plans.domain import Domain, fixed_rectangular_dims, leaves
from lumenfold.plans.geometry import LineRaster, PlaneRaster

#: Discrete values of the naive sampler are below this.
DISCRETE_SPAN = 1 << 32


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]) if values else F.array().cast("array<double>")


def _longs(values) -> Column:
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values]) if values else F.array().cast("array<bigint>")


def points_at(index: DataFrame, dims: int, depth: int = 0, seed: int = 0) -> DataFrame:
    """Uniform points for the rows of ``index`` (sample_index)."""
    i = F.col("sample_index")
    continuous = F.array(*[uniform(seed, i, d) for d in range(dims)]) if dims else F.array().cast("array<double>")
    discrete = [F.floor(uniform(seed, i, dims + d) * DISCRETE_SPAN).cast("bigint") for d in range(depth)]
    return index.select("sample_index", continuous.alias("continuous"), (F.array(*discrete) if discrete else _longs(())).alias("discrete"), F.lit(1.0).alias("weight"))


def naive_monte_carlo(spark: SparkSession, domain: Domain, n: int, seed: int = 0, start: int = 0) -> DataFrame:
    """``n`` uniform points of a rectangular domain, from sample ``start`` on."""
    return naive_points(spark.range(start, start + n).withColumnRenamed("id", "sample_index"), domain, seed)


def naive_points(rows: DataFrame, domain: Domain, seed: int = 0) -> DataFrame:
    """Uniform points of a rectangular domain, one for each row (sample_index)."""
    shape = fixed_rectangular_dims(domain)
    if shape is None:
        raise ValueError("the naive sampler needs a rectangular domain")
    return points_at(rows, *shape, seed)


def raster_line(spark: SparkSession, geometry: LineRaster, start: int = 0, n: int | None = None) -> DataFrame:
    """Points of a line in visiting order: the k-th visit is at pixel ``k * stride mod count``."""
    geometry.check()
    count = geometry.points
    return line_points(spark.range(start, count if n is None else min(count, start + n)).withColumnRenamed("id", "sample_index"), geometry)


def line_points(rows: DataFrame, geometry: LineRaster) -> DataFrame:
    """The points of the visits ``sample_index`` (below the number of pixels) of a line; other columns stay."""
    geometry.check()
    count = geometry.points
    pixel = permuted(F.col("sample_index"), count)
    t = linspace(F.col("pixel"), geometry.linspace.start, geometry.linspace.stop, count)
    at = F.zip_with(_doubles(geometry.offset), _doubles(geometry.direction), lambda o, d: o + F.col("t") * d)
    kept = rows.columns
    rows = rows.withColumn("pixel", pixel).withColumn("t", t)
    return rows.select(*kept, "pixel", at.alias("continuous"), _longs(geometry.discrete).alias("discrete"), F.lit(1.0).alias("weight"))


def raster_plane(spark: SparkSession, geometry: PlaneRaster, start: int = 0, n: int | None = None) -> DataFrame:
    """Points of a plane in visiting order; pixel = u index + v index * width."""
    geometry.check()
    count = geometry.points
    return plane_points(spark.range(start, count if n is None else min(count, start + n)).withColumnRenamed("id", "sample_index"), geometry)


def plane_points(rows: DataFrame, geometry: PlaneRaster) -> DataFrame:
    """The points of the visits ``sample_index`` of a plane; other columns stay."""
    geometry.check()
    width, count = geometry.u_linspace.count, geometry.points
    kept = rows.columns
    rows = rows.withColumn("pixel", permuted(F.col("sample_index"), count))
    u = linspace(F.col("pixel") % width, geometry.u_linspace.start, geometry.u_linspace.stop, width)
    v = linspace(F.floor(F.col("pixel") / width), geometry.v_linspace.start, geometry.v_linspace.stop, geometry.v_linspace.count)
    rows = rows.withColumn("u", u).withColumn("v", v)
    along = F.zip_with(_doubles(geometry.offset), _doubles(geometry.u_vector), lambda o, d: o + F.col("u") * d)
    at = F.zip_with(along, _doubles(geometry.v_vector), lambda o, d: o + F.col("v") * d)
    return rows.select(*kept, "pixel", at.alias("continuous"), _longs(geometry.discrete).alias("discrete"), F.lit(1.0).alias("weight"))


def nested_uniform(rows: DataFrame, domain: Domain, seed: int = 0) -> DataFrame:
    """A point over all leaves of a nested domain for each row (sample_index): a leaf is drawn uniformly, its weight is the number of leaves."""
    flat = list(leaves(domain))
    widest = max(d for _, _, d in flat)
    leaf = F.floor(uniform(seed, F.col("sample_index"), widest) * len(flat)).cast("int")
    rows = rows.withColumn("leaf", leaf)
    path = F.element_at(F.array(*[_longs(p) for p, _, _ in flat]), F.col("leaf") + 1)
    dims = F.element_at(F.array(*[F.lit(d) for _, _, d in flat]), F.col("leaf") + 1)
    coordinates = F.array(*[uniform(seed, F.col("sample_index"), d) for d in range(widest)])
    return rows.select("sample_index", F.slice(coordinates, F.lit(1), dims).alias("continuous"), path.alias("discrete"), F.lit(float(len(flat))).alias("weight"))


def latent_batches(batches: DataFrame, seed: int) -> DataFrame:
    """(batch_id, nr_samples, seed) of batches (batch_id, nr_samples): described, not stored; ``batch_samples`` opens them."""
    return batches.select("batch_id", F.col("nr_samples").cast("int").alias("nr_samples"), (F.col("batch_id") + seed * 1_000_003).cast("bigint").alias("seed"))


class DrawBatch:
    """A table function: the uniform points of the latent batches in a table (batch_id, nr_samples, seed).

    How many columns it returns follows from ``dims``. Numbers are those of ``uniform`` for the batch's seed.
    """

    @staticmethod
    def analyze(batches: AnalyzeArgument, dims: AnalyzeArgument) -> AnalyzeResult:
        if not batches.isTable:
            raise ValueError("batches are given as a table")
        fields = [T.StructField("batch_id", T.LongType()), T.StructField("sample_index", T.LongType()), *[T.StructField(f"x{d}", T.DoubleType()) for d in range(dims.value)]]
        return AnalyzeResult(schema=T.StructType([*fields, T.StructField("weight", T.DoubleType())]))

    def eval(self, batch: Row, dims: int) -> Iterator[tuple]:
        for i in range(batch["nr_samples"] or 0):
            digests = [hashlib.md5(f"latent:{batch['seed']}/{i}:{d}".encode()).hexdigest() for d in range(dims)]
            yield (batch["batch_id"], i, *[int(h[:13], 16) / (1 << 52) for h in digests], 1.0)


def draw_batches(batches: DataFrame, dims: int) -> DataFrame:
    """(batch_id, sample_index, x0.., weight) of latent batches, each drawn where its row is."""
    spark = batches.sparkSession
    spark.udtf.register("draw_batch", F.udtf(DrawBatch))
    return spark.sql(f"SELECT * FROM draw_batch(TABLE(SELECT * FROM {{batches}}) PARTITION BY (batch_id), {int(dims)})", batches=batches)


def batch_points(batches: DataFrame, dims: int) -> DataFrame:
    """The same points by column functions alone."""
    key = F.concat_ws("/", F.col("seed").cast("string"), F.col("sample_index").cast("string"))
    return batch_samples(batches).select("batch_id", "sample_index", *[uniform("latent", key, d).alias(f"x{d}") for d in range(dims)], F.lit(1.0).alias("weight"))


def batch_samples(batches: DataFrame) -> DataFrame:
    """One row per sample of latent batches (batch_id, seed, sample_index within the batch)."""
    inside = F.expr("case when nr_samples > 0 then sequence(0, nr_samples - 1) else cast(array() as array<int>) end")
    return batches.select("batch_id", "seed", F.explode(inside.cast("array<bigint>")).alias("sample_index"))
