"""Control rules of a run: batch sizes, how much to produce, training windows and rates, cursors.

Rules over rows are columns, the ``_column`` forms; those that a driver asks before it plans a job are functions of numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
MIN_BATCH_SIZE = 16
RESIZE_LOW, RESIZE_HIGH = 0.25, 4.0
CARRY_OVER = 0.25
EWMA_ALPHA = 0.2
MAX_PAGE = 10_000


def next_batch_size_column(size: Column, ms_per_sample: Column, target_ms: float, max_size: int) -> Column:
    factor = F.least(F.greatest(target_ms / (ms_per_sample * size), F.lit(RESIZE_LOW)), F.lit(RESIZE_HIGH))
    resized = F.least(F.greatest(F.round(size * factor), F.lit(float(MIN_BATCH_SIZE))), F.lit(float(max_size)))
    known = (ms_per_sample > 0) & (ms_per_sample < float("inf"))  # NaN is above infinity
    return F.when(known, resized).otherwise(size).cast("bigint")


def carried_batch_size_column(size: Column, max_size: int) -> Column:
    return F.least(F.greatest(F.round(size * CARRY_OVER), F.lit(float(MIN_BATCH_SIZE))), F.lit(float(max_size))).cast("bigint")


@dataclass(frozen=True)
class QueueLimits:
    max_queue_size: int = 1024
    max_batches_per_tick: int = 16
    queue_buffer: float = 10.0


def batches_to_produce_column(limits: QueueLimits, pending: Column, open_: Column, evaluators: Column) -> Column:
    none = F.lit(0).cast("bigint")
    wanted = F.greatest(none, F.ceil(evaluators * limits.queue_buffer) - pending)
    return F.greatest(none, F.least(limits.max_queue_size - open_, F.lit(limits.max_batches_per_tick).cast("bigint"), wanted)).cast("bigint")


def split_samples_column(batches: Column, batch_size: Column, max_samples: Column) -> Column:
    """As an array; a null ``max_samples`` sets no limit."""
    full = max_samples.isNull() | (max_samples >= batches * batch_size)
    n = F.when(full, batches).otherwise(F.least(batches, F.ceil(max_samples / batch_size))).cast("int")
    base = F.when(full, batch_size).otherwise(F.floor(max_samples / n)).cast("bigint")
    rest = F.when(full, F.lit(0)).otherwise(F.pmod(max_samples, n)).cast("bigint")
    none = (batches <= 0) | F.coalesce(max_samples == 0, F.lit(False))
    return F.when(none, F.array().cast("array<bigint>")).otherwise(F.concat(F.array(base + rest), F.array_repeat(base, n - 1)))


@dataclass(frozen=True)
class TrainingWindow:
    """What a sampler may produce while it trains in lockstep windows."""

    target: int
    window: int

    def plan(self, ingested: int, pending: int) -> int | None:
        """Samples to produce now; 0 means wait, None that nothing is left."""
        if self.target - ingested - pending <= 0 and pending == 0:
            return None
        if pending:
            return 0
        return min(self.target - ingested, self.window - ingested % self.window)

    def budget(self, ingested: int, pending: int) -> int:
        return max(0, min(self.target - ingested - pending, self.window - ingested % self.window))

    def budget_column(self, ingested: Column, pending: Column) -> Column:
        return F.greatest(F.lit(0).cast("bigint"), F.least(self.target - ingested - pending, self.window - ingested % self.window))

    def crossed(self, before: int, after: int) -> int:
        """Grid updates that ingesting from ``before`` to ``after`` samples triggers."""
        return after // self.window - before // self.window


def training_rate(initial: float, final: float, ingested: int, target: int) -> float:
    """Geometric from the initial to the final rate; linear if either is not positive."""
    p = min(ingested, target) / target if target > 0 else 1.0
    if initial > 0 and final > 0:
        return initial * (final / initial) ** p
    return initial + (final - initial) * p


def training_rate_column(initial: float, final: float, ingested: Column, target: int) -> Column:
    p = F.least(ingested, F.lit(target)) / target if target > 0 else F.lit(1.0)
    return initial * F.pow(F.lit(final / initial), p) if initial > 0 and final > 0 else initial + (final - initial) * p


def page_limit(n: int | None, default: int = 500) -> int:
    """Rows of a page that was asked for: 1 to ``MAX_PAGE``."""
    return min(max(default if n is None else n, 1), MAX_PAGE)
