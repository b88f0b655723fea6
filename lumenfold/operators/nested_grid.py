"""An adaptive density over nested domains, as tables: branch probabilities of every node, bin edges of every leaf.

A point descends level by level: at each node a uniform number falls into one of the cumulative probabilities, and at the
leaf one number per dimension into its bins. Its weight is taken once, for the whole way down: one over the probabilities
of all branches and the density in the leaf. A window's squared contributions are summed for all nodes and leaves in one
grouped aggregate; sums of windows that are not full yet are kept and added to. The grid has the size of the domain, not
of the samples, and is sent to all tasks while its rows are at most ``SENT_ROWS``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.numeric import is_finite, uniform
from lumenfold.operators.vegas import refine_branches, refine_edges
from lumenfold.plans.domain import Continuous, Domain, leaves

SENT_ROWS = 1_000_000
BRANCHES = "path array<bigint>, branch bigint, probability double"
EDGES = "path array<bigint>, dim int, edges array<double>"
CELLS = "path array<bigint>, dim int, bin bigint, mass double, n bigint"


@dataclass(frozen=True)
class NestedGrid:
    branches: DataFrame
    edges: DataFrame
    depth: int
    rows: int

    @classmethod
    def uniform(cls, spark: SparkSession, domain: Domain, bins: int = 64) -> NestedGrid:
        even = [i / bins for i in range(bins + 1)]
        nodes: list[tuple] = []
        _check(domain, (), nodes)
        edges = [(list(path), d, even) for path, _, dims in leaves(domain) for d in range(dims)]
        return cls.of(spark, nodes, edges)

    @classmethod
    def of(cls, spark: SparkSession, branches: Sequence[tuple], edges: Sequence[tuple]) -> NestedGrid:
        """From rows (path, branch, probability) and (leaf path, dim, edges)."""
        depth = max((len(e[0]) for e in edges), default=0)
        return cls(spark.createDataFrame(list(branches), BRANCHES), spark.createDataFrame(list(edges), EDGES), depth, len(branches) + len(edges))

    def matches(self, domain: Domain) -> bool:
        """Whether the grid has just the leaves of a domain, with as many dimensions."""
        wanted = {(path, dims) for path, _, dims in leaves(domain)}
        found = {(tuple(r["path"]), r["n"]) for r in self.edges.groupBy("path").agg(F.count("*").alias("n")).collect()}
        return found == wanted

    def sent(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.rows <= SENT_ROWS else table


def _check(domain: Domain, path: tuple, nodes: list[tuple]) -> None:
    if isinstance(domain, Continuous):
        if domain.dims <= 0:
            raise ValueError("a grid needs a dimension in every leaf")
        return
    if not domain.branches:
        raise ValueError("a grid needs a branch on every axis")
    for index, branch in domain.branches:
        nodes.append((list(path), index, 1 / len(domain.branches)))
        _check(branch, (*path, index), nodes)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once for a row, however often ``f`` takes it and in whatever lambda."""
    return F.transform(F.array(value), f)[0]


def draw(rows: DataFrame, grid: NestedGrid, seed: int) -> DataFrame:
    """``rows`` (sample_index, ...) with a point each: ``discrete`` (the path), ``continuous``, ``bins`` and ``weight``.

    Number ``level`` of a sample chooses the branch at that level, number ``depth + d`` the place in dimension d.
    """
    index, kept = F.col("sample_index"), rows.columns
    order = F.array_sort(F.collect_list(F.struct("branch", "probability")))
    upto = lambda i: F.aggregate(F.slice("_node", F.lit(1), i + 1), F.lit(0.0), lambda s, b: s + b["probability"])
    nodes = grid.branches.groupBy(F.col("path").alias("_path")).agg(order.alias("_node"))
    nodes = grid.sent(nodes.withColumn("_upto", F.transform("_node", lambda _, i: upto(i))))
    out = rows.withColumns({"_path": F.array().cast("array<bigint>"), "_p": F.lit(1.0)})
    for level in range(grid.depth):
        passed = _once(uniform(seed, index, level), lambda u: F.size(F.filter("_upto", lambda s: s <= u)))
        out = out.join(nodes, "_path", "left")
        out = out.withColumn("_b", F.when(F.col("_node").isNotNull(), F.element_at("_node", F.least(passed, F.size("_node") - 1) + 1)))
        out = out.withColumn("_p", F.col("_p") * F.coalesce("_b.probability", F.lit(1.0)))
        path = F.when(F.col("_b").isNull(), F.col("_path")).otherwise(F.concat("_path", F.array("_b.branch")))
        out = out.select(*kept, path.alias("_path"), "_p")
    dims = F.transform(F.array_sort(F.collect_list(F.struct("dim", "edges"))), lambda e: e["edges"])
    leaf = grid.sent(grid.edges.groupBy(F.col("path").alias("_path")).agg(dims.alias("_edges")))
    out = out.join(leaf, "_path")

    def place(e: Column, y: Column, k: Column) -> Column:
        width = F.element_at(e, k + 2) - F.element_at(e, k + 1)
        return F.struct(k.cast("bigint").alias("bin"), (F.element_at(e, k + 1) + (y - k) * width).alias("x"), ((F.size(e) - 1) * width).alias("w"))

    drawn = lambda d, n: uniform(seed, index, d + grid.depth) * n
    at = lambda e, d: _once(drawn(d, F.size(e) - 1), lambda y: place(e, y, F.floor(y).cast("int")))
    out = out.withColumn("_at", F.transform("_edges", at))
    weight = F.aggregate("_at", 1 / F.col("_p"), lambda w, a: w * a["w"])
    return out.select(*kept, F.col("_path").alias("discrete"), F.transform("_at", lambda a: a["x"]).alias("continuous"), F.transform("_at", lambda a: a["bin"]).alias("bins"), weight.alias("weight"))


def window_cells(points: DataFrame, value: Column) -> DataFrame:
    """(path, dim, bin, mass, n) of a window's points: each leaf's bins, and each node's branches as dimension -1."""
    contribution = value * F.col("weight")
    mass = F.when(is_finite(contribution * contribution), contribution * contribution).otherwise(0.0)
    cell = lambda path, dim, b: F.struct(path.alias("path"), dim.cast("int").alias("dim"), b.cast("bigint").alias("bin"))
    path = F.col("discrete")
    inner = F.transform("bins", lambda b, d: cell(path, d, b))
    outer = F.transform(path, lambda b, level: cell(F.slice(path, F.lit(1), level), F.lit(-1), b))
    flat = points.select(mass.alias("mass"), F.explode(F.concat(inner, outer)).alias("c"))
    return flat.groupBy("c.path", "c.dim", "c.bin").agg(F.sum("mass").alias("mass"), F.count("*").alias("n"))


def add_cells(kept: DataFrame, window: DataFrame) -> DataFrame:
    """Cells of a window that is not full yet, with those of more samples."""
    return kept.unionByName(window).groupBy("path", "dim", "bin").agg(F.sum("mass").alias("mass"), F.sum("n").alias("n"))


def refine(grid: NestedGrid, cells: DataFrame, rate: float) -> NestedGrid:
    """The grid moved towards a full window's mass; a node or leaf that no sample reached stays as it is."""
    leaf = grid.edges.join(cells.where("dim >= 0").groupBy("path", "dim").agg(F.collect_list(F.struct("bin", "mass")).alias("mass")), ["path", "dim"], "left")
    node = grid.branches.join(cells.where("dim = -1").select("path", F.col("bin").alias("branch"), "mass"), ["path", "branch"], "left")

    def move_edges(batches):
        for batch in batches:
            moved = []
            for edges, mass in zip(batch["edges"], batch["mass"]):
                by_bin = [0.0] * (len(edges) - 1)
                for cell in mass if mass is not None else ():
                    by_bin[cell["bin"]] = cell["mass"]
                moved.append(list(refine_edges(tuple(edges), by_bin, rate)))
            yield pd.DataFrame({"path": batch["path"], "dim": batch["dim"], "edges": moved})

    def move_branches(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("branch")
        moved = refine_branches(tuple(group["probability"]), group["mass"].fillna(0.0).tolist(), rate)
        return group[["path", "branch"]].assign(probability=moved)

    edges = leaf.mapInPandas(move_edges, EDGES)
    named = node.withColumn("node", F.array_join("path", ","))
    branches = named.groupBy("node").applyInPandas(lambda g: move_branches(g), BRANCHES)
    return NestedGrid(branches, edges, grid.depth, grid.rows)
