"""Panels that are asked for again and again: series thinned by levels, answered in full or by what is new.

Level L of a series has every 2^L-th of its points, and the last one, which is provisional unless it is one of these. A
cursor ``id:level`` says what a reader has: if the level is still right, the answer is the points after ``id`` that belong
to the level, to be appended in place of the provisional one; otherwise it is the whole level, to replace everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import scan
from lumenfold.operators.panels import BUDGET, downsample_level


def format_cursor(snapshot_id: Column, level: Column) -> Column:
    return F.concat_ws(":", F.coalesce(snapshot_id, F.lit(0)).cast("string"), level.cast("string"))


def parse_cursor(cursor: Column) -> tuple[Column, Column]:
    """Id and level; an id of 0 or no cursor stands for nothing yet, a missing level for 0. Anything else is an error."""
    good = cursor.rlike(r"^[0-9]+(:[0-9]+)?$")
    part = lambda i: F.try_element_at(F.split(cursor, ":"), F.lit(i)).cast("bigint")
    wrong = F.raise_error(F.concat(F.lit("not a cursor: "), cursor)).cast("bigint")
    snapshot = F.when(cursor.isNull(), F.lit(None)).when(good, F.nullif(part(1), F.lit(0))).otherwise(wrong)
    return snapshot, F.when(cursor.isNull() | good, F.coalesce(part(2), F.lit(0)))


def levels(series: DataFrame, keys: Sequence[str], order: str, budget: int = BUDGET, target: int = scan.TARGET) -> DataFrame:
    """The pyramid (series columns, level, place): each point in all levels up to the series' own that have it."""
    placed = scan.positions(series, keys, [order], "_i", "_n", target)
    top = downsample_level(F.col("_n"), budget)
    halvings = F.when(F.col("_i") == 0, top).otherwise(F.least(top, F.length(F.regexp_extract(F.bin("_i"), "(0*)$", 1))))
    opened = placed.withColumn("level", F.explode(F.sequence(F.lit(0), halvings)))
    return opened.select(*series.columns, "level", F.expr("shiftright(_i, level)").alias("place"))


def answer(series: DataFrame, keys: Sequence[str], order: str, cursors: DataFrame | None = None, budget: int = BUDGET, target: int = scan.TARGET) -> DataFrame:
    """``series`` as far as it belongs into the answers to ``cursors`` (keys, cursor), with ``mode``, ``provisional`` and the next ``cursor``."""
    placed = scan.positions(series, keys, [order], "_i", "_n", target).withColumn("_level", downsample_level(F.col("_n"), budget))
    ends = series.groupBy(*keys).agg(F.max(order).alias("_end"))
    known = ends if cursors is None else ends.join(cursors, list(keys), "left")
    had, level = parse_cursor(F.col("cursor") if cursors is not None else F.lit(None).cast("string"))
    known = known.select(*keys, "_end", had.alias("_had"), level.alias("_had_level"))
    rows = placed.join(known, list(keys))
    append = F.col("_had").isNotNull() & (F.col("_had_level") == F.col("_level"))
    on_level = F.col("_i") % F.pow(F.lit(2.0), F.col("_level")).cast("bigint") == 0
    wanted = (on_level | (F.col("_i") == F.col("_n") - 1)) & (~append | (F.col(order) > F.col("_had")))
    mode = F.when(append, "append").otherwise("replace").alias("mode")
    return rows.where(wanted).select(*series.columns, mode, (~on_level).alias("provisional"), format_cursor(F.col("_end"), F.col("_level")).alias("cursor"))


def cursors_of(answers: DataFrame, keys: Sequence[str], before: DataFrame | None = None) -> DataFrame:
    """(keys, cursor) to ask with next; a key without news keeps its cursor."""
    fresh = answers.groupBy(*keys).agg(F.max("cursor").alias("cursor"))
    return fresh if before is None else fresh.unionByName(before.join(fresh, list(keys), "left_anti"))


def applied(shown: DataFrame | None, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a reader shows after the answers: (series columns, provisional)."""
    news = answers.drop("mode", "cursor")
    if shown is None:
        return news
    modes = answers.groupBy(*keys).agg(F.max("mode").alias("_mode"))
    kept = shown.join(modes, list(keys), "left").where("_mode is null or (_mode = 'append' and not provisional)").drop("_mode")
    return kept.unionByName(news)
