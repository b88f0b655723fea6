"""Ordered scans over keys of any size: running positions, sums and states without a task, list or window per key.

Rows are cut into *blocks* of the order's first column, so a key that holds a third of all rows spans as many tasks as it
has blocks. Each block is scanned by itself; what a block hands on to the next is one row for each key and block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block where the order's first column is even.
TARGET = 1 << 16
#: Blocks of a scan over the whole table, whose totals pass the driver.
MOST_BLOCKS = 4096
#: Rows, and states, that are folded in one list.
FAN = 256

_BLOCK = "_block"


def whole_number(rows: DataFrame, column: str) -> Column:
    """A column as a whole number of the same order: times in microseconds, dates in days."""
    kind = dict(rows.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.unix_date(column) if kind == "date" else F.floor(column).cast("bigint")


@dataclass(frozen=True)
class Blocks:
    rows: DataFrame
    n_rows: int
    n_blocks: int


def blocks(rows: DataFrame, at: Column, target: int = TARGET, most: int | None = None) -> Blocks:
    """``rows`` with a block number that does not fall as ``at`` rises; rows without ``at`` come first."""
    n, low, high = rows.agg(F.count("*"), F.min(at), F.max(at)).first()
    count = max(1, -(-n // target))
    count = count if most is None else min(count, most)
    width = 1 if low is None else (high - low) // count + 1
    return Blocks(rows.withColumn(_BLOCK, F.coalesce(F.floor((at - F.lit(low or 0)) / width) + 1, F.lit(0)).cast("bigint")), n, count + 1)


def positions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, total: str | None = None, target: int = TARGET) -> DataFrame:
    """``rows`` with each one's place in its key, from 0 on, and the number of the key's rows as ``total``."""
    cut = blocks(rows, whole_number(rows, order[0]), target).rows
    inside = F.row_number().over(Window.partitionBy(*keys, _BLOCK).orderBy(*order))
    sizes = cut.groupBy(*keys, _BLOCK).agg(F.count("*").alias("_n"))
    of_key = Window.partitionBy(*keys)
    before = F.sum("_n").over(of_key.orderBy(_BLOCK)) - F.col("_n")
    sizes = sizes.select(*keys, _BLOCK, before.alias("_before"), F.sum("_n").over(of_key).alias("_total"))  # a row per key and block
    out = cut.withColumn("_inside", inside).join(sizes, [*keys, _BLOCK]).withColumn(name, F.col("_before") + F.col("_inside") - 1)
    return out.select(*rows.columns, name, *([F.col("_total").alias(total)] if total else []))


def carry_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, target: int = TARGET) -> DataFrame:
    """``rows`` with the last ``value`` that is not null at or before each, in the order given, among those of its key."""
    cut = blocks(rows, whole_number(rows, order[0]), target).rows
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    given = F.col(value).isNotNull()
    last = F.max_by(F.when(given, F.col(value)), F.when(given, F.struct(*order))).alias("_last")
    handed = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1))
    carried = cut.groupBy(*keys, _BLOCK).agg(last).select(*keys, _BLOCK, handed.alias("_handed"))  # a row per key and block
    out = cut.withColumn("_inside", inside).join(carried, [*keys, _BLOCK])
    return out.select(*rows.columns, F.coalesce("_inside", "_handed").alias(name))


def running_sums(rows: DataFrame, order: Sequence[str], sums: Sequence[str], at: Column | None = None, target: int = TARGET) -> DataFrame:
    """``rows`` with each of ``sums`` replaced by its sum up to the row, over the whole table.

    Two passes: the totals of at most ``MOST_BLOCKS`` blocks pass the driver and come back as offsets. Nothing is null.
    """
    cut = blocks(rows, whole_number(rows, order[0]) if at is None else at, target, MOST_BLOCKS).rows
    totals = cut.groupBy(_BLOCK).agg(*[F.sum(s).alias(s) for s in sums])
    offsets, upto = [], None
    for r in sorted(totals.collect(), key=lambda r: r[_BLOCK]):
        upto = [s - s for s in r[1:]] if upto is None else upto
        offsets.append((r[_BLOCK], *upto))
        upto = [a + b for a, b in zip(upto, r[1:])]
    before = rows.sparkSession.createDataFrame(offsets, totals.schema)
    before = F.broadcast(before.select(_BLOCK, *[F.col(s).alias(f"_before_{s}") for s in sums]))
    inside = Window.partitionBy(_BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.select("*", *[F.sum(s).over(inside).alias(f"_inside_{s}") for s in sums]).join(before, _BLOCK)
    return out.select(*[(F.col(f"_before_{c}") + F.col(f"_inside_{c}")).alias(c) if c in sums else c for c in rows.columns])


def composed(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    x: str,
    fold: Callable[[Column], Column],
    compose: Callable[[Column, Column], Column],
    target: int = TARGET,
) -> DataFrame:
    """(keys, state): the composition, in order, of what ``fold`` makes of stretches of each key's values.

    ``fold`` takes an array of at most ``FAN`` values, ``compose`` two states of which the second comes later. As it is
    associative, stretches are composed ``FAN`` at a time: first those of a block, then the blocks.
    """
    cut = blocks(rows.select(*keys, *order, F.col(x).alias("_x")), whole_number(rows, order[0]), target)
    place = F.row_number().over(Window.partitionBy(*keys, _BLOCK).orderBy(*order)) - 1
    numbered = cut.rows.withColumn("_i", place.cast("bigint"))
    states = _grouped(numbered, [*keys, _BLOCK], "_i", "_x", fold)
    size = -(-cut.n_rows // FAN)
    while size > 1:  # one key and block may hold all rows
        states, size = _grouped(states, [*keys, _BLOCK], "_i", "_state", _together(compose)), -(-size // FAN)
    states = states.drop("_i").select(*keys, F.col(_BLOCK).alias("_i"), F.col("_state").alias("state"))
    return joined(states, keys, compose, cut.n_blocks + 1)


def joined(states: DataFrame, keys: Sequence[str], compose: Callable[[Column, Column], Column], size: int) -> DataFrame:
    """(keys, state): the composition of the states (keys, _i, state) of a key in the order of ``_i``, from 0 to below ``size``."""
    states = states.select(*keys, "_i", F.col("state").alias("_state"))
    size = max(size, 2)  # at least once
    while size > 1:
        states, size = _grouped(states, list(keys), "_i", "_state", _together(compose)), -(-size // FAN)
    return states.select(*keys, F.col("_state").alias("state"))


def _together(compose: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
    return lambda s: F.reduce(F.slice(s, F.lit(2), F.size(s)), s[0], compose)


def _grouped(rows: DataFrame, keys: list[str], place: str, value: str, fold: Callable[[Column], Column]) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), F.col(value).alias("v"))))
    lists = rows.groupBy(*keys, F.floor(F.col(place) / FAN).cast("bigint").alias("_next")).agg(F.transform(listed, lambda e: e["v"]).alias("_list"))
    return lists.select(*keys, F.col("_next").alias("_i"), fold(F.col("_list")).alias("_state"))
