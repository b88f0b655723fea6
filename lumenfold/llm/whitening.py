"""Whitening of embeddings: blockwise QR of the centred rows and a bidiagonal qd solver for what is left of them.

1. An entry c becomes the whole number floor(64 c) + 1000000. Each distinct vector of whole numbers is once in the *fit
   list*: n vectors with sums S per dimension, both exact.
2. *Blockwise QR.* Every task reduces its centred rows (n x - S) / n, a block at a time, to one triangle of d x d;
   triangles are reduced ``FAN`` at a time until one is left. The covariance itself is never formed, so nothing is
   squared before the solver.
3. *Solver* (``bidiagonal``): Householder reflections to bidiagonal form, dqds for the singular values, twisted
   factorisations for the directions. It sees one triangle, whose size is that of a vector squared.
4. Every row is projected on the leading directions. The covariance of the whitened fit list is summed to the n and
   compared with the identity.

The distinct vectors are found by a grouping with partial sums, so a vector that a third of all rows share costs one row
for each task. Sums and triangles are of one size whatever the number of rows.

Cases: rows without a vector, or with a null or non-finite entry, are left out, and so are vectors of another length than
the most frequent one (the longer of two) and entries of 2**56 or more, which have no whole number of 64 bits. Repeated
rows give their rows each; a null id is passed on; other columns are not read. With no row left there is no result. A
direction in which the fit list does not differ has ``whitened`` and ``explained`` 0 and no part in ``identity_error``. A
deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bidiagonal, common

COMPONENTS = 16
#: Triangles that are reduced together.
FAN = 16
#: Numbers of a block.
BLOCK = 1 << 20
#: Singular values under this share of the largest are those of directions without variance.
RANK = 1e-12
#: An entry of this size has no whole number.
TOO_LARGE = float(1 << 56)

SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector is whole, finite and as long as most."""
    usable = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < TOO_LARGE)
    v = F.col("embedding").cast("array<double>")
    good = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0").where(F.forall("v", usable))
    common_length = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = common_length["d"] if common_length else 0
    return good.where(F.size("v") == d).select("vec_id", F.transform("v", lambda c: F.floor(c * 64).cast("bigint") + 1_000_000).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, BLOCK // d)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class Fit:
    """n, the sums S and what follows from them for blocks of vectors."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.d = n, sums, len(sums)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: 64 bits while they suffice, whole numbers of any size otherwise."""
        largest = max(int(np.abs(x).max(initial=0)), 1)
        if self.n * largest < 1 << 62 and max(map(abs, self.sums)) < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(float) / self.n


def _squared(deviations: np.ndarray) -> list[int | None]:
    largest = int(np.abs(deviations).max(initial=0))
    if largest * largest * deviations.shape[1] < 1 << 63:
        return (deviations * deviations).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in deviations]
    return [v if v < 1 << 63 else None for v in exact]


def fit_list(vectors: DataFrame) -> tuple[DataFrame, Fit | None]:
    """The distinct vectors (x), written once, and their number and sums."""
    listed = common.settle(vectors.select("x").distinct(), "fit-list")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            d = len(batch.column("x")[0])
            for part, x in _blocks([batch], d):
                n += part.num_rows
                wide = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62
                own = np.array(x.astype(object).sum(axis=0) if wide else x.sum(axis=0), dtype=object)
                total = own if total is None else total + own
        if total is not None:
            of = pa.array([pa.scalar(str(s)).cast(pa.decimal128(38, 0)).as_py() for s in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(total), pa.int64()), pa.array(range(len(total)), pa.int32()), of], names=["n", "i", "s"])

    found = listed.mapInArrow(sums, "n bigint, i int, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return listed, Fit(found[0]["n"], [int(r["s"]) for r in found]) if found else None


def triangle(listed: DataFrame, fit: Fit, fan: int = FAN) -> np.ndarray:
    """R of the centred rows' QR factorisation."""
    d = fit.d

    def reduce(rows: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(rows, mode="r")
        return np.vstack([r, np.zeros((d - len(r), d))])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in _blocks(batches, d):
            rows = fit.centred(x)
            r = reduce(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    def together(group: pd.DataFrame) -> pd.DataFrame:
        r = reduce(np.vstack([np.asarray(v, float).reshape(d, d) for v in group.sort_values("part")["r"]]))
        return pd.DataFrame({"part": [int(group["part"].min()) // fan], "r": [r.ravel()]})

    schema = "part bigint, r array<double>"
    level = common.settle(listed.mapInArrow(own, schema), "triangles")
    while level.count() > 1:
        before, level = level, common.settle(level.groupBy(F.floor(F.col("part") / fan)).applyInPandas(together, schema), "triangles")
        common.release(before)
    r = np.array(level.first()["r"], float).reshape(d, d)
    common.release(level)
    return r


class Whitening:
    """Directions, scales and shares of the leading components of a fit list."""

    def __init__(self, fit: Fit, r: np.ndarray, components: int = COMPONENTS):
        squares, directions = bidiagonal.right_singular(r)
        k = min(components, fit.d)
        self.fit, self.k = fit, k
        self.varies = squares[:k] > squares[0] * RANK * RANK
        signs = np.sign(directions[np.arange(fit.d), np.abs(directions).argmax(axis=1)])
        scale = np.where(self.varies, np.sqrt(fit.n / np.where(self.varies, squares[:k], 1.0)), 0.0)
        self.onto = (directions[:k] * signs[:k, None] * scale[:, None]).T
        self.explained = np.where(self.varies, squares[:k] / max(squares.sum(), np.finfo(float).tiny), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.fit.centred(x) @ self.onto

    def identity_error(self, listed: DataFrame) -> float:
        """The largest entry of the whitened fit list's covariance minus the identity."""
        k, whiten, d = self.k, self.whitened, self.fit.d

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k + 1, k))
            for _, x in _blocks(batches, d):
                w = whiten(x)
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "s"])

        summed = listed.mapInArrow(moments, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
        found = np.array([r["s"] for r in summed]).reshape(k + 1, k) / self.fit.n
        apart = np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k))
        return float(apart[np.ix_(self.varies, self.varies)].max(initial=0.0))


def whiten(rows: DataFrame, components: int = COMPONENTS, fan: int = FAN) -> DataFrame:
    """One row for each usable vector and component: see the module's description."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows)
    listed, fit = fit_list(vectors)
    if fit is None:
        common.release(listed)
        return spark.createDataFrame([], SCHEMA)
    model = Whitening(fit, triangle(listed, fit, fan), components)
    error, k = model.identity_error(listed), model.k
    common.release(listed)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, fit.d):
            m = len(x)
            repeated = pa.array(np.repeat(np.arange(m), k))
            deviation = pa.array(_squared(fit.deviations(x)), pa.int64())
            columns = [part.column("vec_id").take(repeated), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)),
                       deviation.take(repeated), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return vectors.mapInArrow(project, SCHEMA)


def op12_bidiagonal_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.read_table(spark, sf_dir, "embeddings"))
