"""An adaptive importance grid: piecewise-constant density per dimension, refined in windows of samples (VEGAS).

The grid is small (dims x bins edges) and travels as literals. One Spark job per window samples, evaluates and sums
the squared contributions per bin; the driver moves the edges. Samples come from counters, so a run that pauses and
resumes from (grid, next sample) draws the same points.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.numeric import is_finite, uniform
from lumenfold.operators.evaluate import Evaluator
from lumenfold.operators.generate import batch_samples
from lumenfold.plans.control import TrainingWindow, training_rate

#: The most that the probabilities of an axis may differ by.
MAX_PROBABILITY_RATIO = 30.0


@dataclass(frozen=True)
class Grid:
    """Edges of each dimension's bins, and the probabilities of the branches of a discrete axis above them."""

    edges: tuple[tuple[float, ...], ...]
    branches: tuple[float, ...] = ()

    @classmethod
    def uniform(cls, dims: int, bins: int = 64, branches: int = 0) -> Grid:
        if dims <= 0:
            raise ValueError("a grid needs a dimension")
        even = tuple(i / bins for i in range(bins + 1))
        return cls((even,) * dims, (1 / branches,) * branches if branches else ())

    @property
    def bins(self) -> int:
        return len(self.edges[0]) - 1

    def to_json(self) -> str:
        return json.dumps({"edges": self.edges, "branches": self.branches})

    @classmethod
    def from_json(cls, text: str) -> Grid:
        raw = json.loads(text)
        return cls(tuple(map(tuple, raw["edges"])), tuple(raw["branches"]))

    def matches(self, dims: int, branches: int = 0) -> bool:
        return len(self.edges) == dims and len(self.branches) == branches


def sample(rows: DataFrame, grid: Grid, seed) -> DataFrame:
    """Points drawn from the grid's density for rows (sample_index); ``bin_d`` is the bin in dimension d.

    ``seed`` is a number or a column, such as the seed of a latent batch. The weight is one over the density.
    """
    key = F.col("sample_index") if not isinstance(seed, Column) else F.concat_ws("/", seed.cast("string"), F.col("sample_index").cast("string"))
    base = seed if not isinstance(seed, Column) else "latent"
    keep = rows.columns
    n = grid.bins
    for d, edges in enumerate(grid.edges):
        lows = F.array(*[F.lit(float(e)) for e in edges])
        rows = rows.withColumn(f"_y{d}", uniform(base, key, d) * n)
        rows = rows.withColumn(f"bin_{d}", F.floor(F.col(f"_y{d}")).cast("int"))
        rows = rows.withColumn(f"_lo{d}", F.element_at(lows, F.col(f"bin_{d}") + 1))
        rows = rows.withColumn(f"_w{d}", F.element_at(lows, F.col(f"bin_{d}") + 2) - F.col(f"_lo{d}"))
    at = F.array(*[F.col(f"_lo{d}") + (F.col(f"_y{d}") - F.col(f"bin_{d}")) * F.col(f"_w{d}") for d in range(len(grid.edges))])
    weight = F.lit(1.0)
    for d in range(len(grid.edges)):
        weight = weight * n * F.col(f"_w{d}")
    branch, discrete = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")
    if grid.branches:
        u, upto = uniform(base, key, len(grid.edges)), 0.0
        branch = F.lit(len(grid.branches) - 1).cast("bigint")
        bounds = []
        for i, p in enumerate(grid.branches[:-1]):
            upto += p
            bounds.append((upto, i))
        for bound, i in reversed(bounds):
            branch = F.when(u < bound, F.lit(i).cast("bigint")).otherwise(branch)
        discrete = F.array(branch)
        probability = F.element_at(F.array(*[F.lit(p) for p in grid.branches]), branch.cast("int") + 1)
        weight = weight / probability
    bins = [f"bin_{d}" for d in range(len(grid.edges))]
    return rows.select(*keep, at.alias("continuous"), discrete.alias("discrete"), weight.alias("weight"), *bins)


def window_sums(points: DataFrame, value: Column, dims: int) -> DataFrame:
    """(axis, bin, mass, n): squared contributions per bin of every dimension and of the discrete axis (-1)."""
    contribution = value * F.col("weight")
    squared = F.when(is_finite(contribution * contribution), contribution * contribution).otherwise(0.0)
    axes = [F.struct(F.lit(d).alias("axis"), F.col(f"bin_{d}").alias("bin")) for d in range(dims)]
    axes.append(F.struct(F.lit(-1).alias("axis"), F.coalesce(F.try_element_at("discrete", F.lit(1)).cast("int"), F.lit(0)).alias("bin")))
    flat = points.select(squared.alias("m"), F.explode(F.array(*axes)).alias("a"))
    return flat.groupBy("a.axis", "a.bin").agg(F.sum("m").alias("mass"), F.count("*").alias("n"))


def refine_edges(edges: tuple[float, ...], mass: list[float], rate: float) -> tuple[float, ...]:
    """Edges moved so that every bin holds the same share of the smoothed and damped mass."""
    n = len(mass)
    if n < 2 or sum(mass) <= 0:
        return edges
    smooth = [(7 * mass[0] + mass[1]) / 8, *[(mass[i - 1] + 6 * mass[i] + mass[i + 1]) / 8 for i in range(1, n - 1)], (mass[-2] + 7 * mass[-1]) / 8]
    total = sum(smooth)
    damped = []
    for m in smooth:
        r = m / total
        damped.append(0.0 if r <= 0 else 1.0 if r >= 1 else ((1 - r) / -math.log(r)) ** rate)
    share = sum(damped) / n
    out, have, k = [edges[0]], 0.0, 0
    for _ in range(n - 1):
        while have < share and k < n:
            have += damped[k]
            k += 1
        have -= share
        width = edges[k] - edges[k - 1]
        out.append(edges[k] - (have / damped[k - 1] * width if damped[k - 1] > 0 else 0.0))
    return (*out, edges[-1])


def refine_branches(probabilities: tuple[float, ...], mass: list[float], rate: float) -> tuple[float, ...]:
    """Probabilities moved towards the root of each branch's mass, none below the largest over the allowed ratio."""
    if len(probabilities) < 2 or sum(mass) <= 0:
        return probabilities
    roots = [math.sqrt(m) for m in mass]
    wanted = [(1 - rate) * p + rate * r / sum(roots) for p, r in zip(probabilities, roots)]
    floor = max(wanted) / MAX_PROBABILITY_RATIO
    wanted = [max(w, floor) for w in wanted]
    return tuple(w / sum(wanted) for w in wanted)


@dataclass(frozen=True)
class Training:
    """A training run's settings and state; ``step`` of a saved state continues it exactly."""

    grid: Grid
    seed: int = 0
    target: int = 0
    window: int = 10_240
    initial_rate: float = 0.1
    final_rate: float = 0.1
    ingested: int = 0
    updates: int = 0
    #: (axis, bin, mass) of a window that is not full yet.
    partial: tuple[tuple[int, int, float], ...] = ()

    def remaining(self) -> int:
        return max(0, self.target - self.ingested)

    def snapshot(self) -> str:
        return json.dumps({**self.__dict__, "grid": self.grid.to_json()})

    @classmethod
    def restore(cls, text: str) -> Training:
        raw = json.loads(text)
        return cls(**{**raw, "grid": Grid.from_json(raw["grid"]), "partial": tuple(map(tuple, raw["partial"]))})

    def step(self, index: Callable[[int, int], DataFrame], value: Callable[[DataFrame], Column]) -> Training:
        """The rest of a window, or of the target: sample, evaluate, sum per bin, move the grid if the window is full.

        ``index`` gives the rows (sample_index) from one number up to another. What a window that is not full yet has summed
        stays in the state, so stopping inside a window loses nothing.
        """
        n = TrainingWindow(self.target, self.window).budget(self.ingested, 0)
        if n <= 0:
            return self
        after, grid = self.ingested + n, self.grid
        points = sample(index(self.ingested, after), grid, self.seed)
        cells = {(axis, b): m for axis, b, m in self.partial}
        for r in window_sums(points, value(points), len(grid.edges)).collect():  # bins x dims rows
            cells[r["axis"], r["bin"]] = cells.get((r["axis"], r["bin"]), 0.0) + r["mass"]
        if not TrainingWindow(self.target, self.window).crossed(self.ingested, after):
            return replace(self, ingested=after, partial=tuple((*k, m) for k, m in sorted(cells.items())))
        rate = training_rate(self.initial_rate, self.final_rate, after, self.target)
        edges = tuple(refine_edges(e, [cells.get((d, b), 0.0) for b in range(grid.bins)], rate) for d, e in enumerate(grid.edges))
        heads = [cells.get((-1, b), 0.0) for b in range(len(grid.branches))]
        return replace(self, grid=Grid(edges, refine_branches(grid.branches, heads, rate)), ingested=after, updates=self.updates + 1, partial=())

    def run(self, index: Callable[[int, int], DataFrame], value: Callable[[DataFrame], Column]) -> Training:
        state = self
        while state.remaining():
            state = state.step(index, value)
        return state

    def diagnostics(self) -> dict[str, float]:
        left = self.window - self.ingested % self.window
        return {"ingested": self.ingested, "updates": self.updates, "window_remaining": left, "rate": training_rate(self.initial_rate, self.final_rate, self.ingested, self.target)}


def counted(spark: SparkSession) -> Callable[[int, int], DataFrame]:
    """Rows that are numbers alone."""
    return lambda start, stop: spark.range(start, stop).withColumnRenamed("id", "sample_index")


def train(spark: SparkSession, evaluator: Evaluator, state: Training) -> Training:
    return state.run(counted(spark), lambda points: evaluator.value(F.col("continuous"), F.col("discrete")))


def infer(batches: DataFrame, grid: Grid) -> DataFrame:
    """The points of latent batches (batch_id, nr_samples, seed), drawn where they are evaluated from the frozen grid."""
    return sample(batch_samples(batches), grid, F.col("seed"))
