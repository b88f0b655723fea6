"""Streams of batch results: idempotent merging, ordered release, moving averages and leases.

Every stream here has a batch form whose result it must equal once all input has arrived.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenfold.operators import rolling
from lumenfold.operators.observe import SCALAR_STATE, scalar_partial


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """The files that arrive in a folder; all of them at once, or so many at a time."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)


def merge_results(stream: DataFrame, keys: list[str], sink: str, checkpoint: str) -> None:
    """Partial states of every micro-batch, under its number: a replayed micro-batch replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        states = batch.dropDuplicates(["batch_id"]).groupBy(*keys).agg(*scalar_partial(F.col("value"), F.col("weight")))
        states.withColumn("micro_batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/micro_batch_{number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merged(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    parts = spark.read.parquet(f"{sink}/micro_batch_*")
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SCALAR_STATE])


def lease_sessions(stream: DataFrame, key: str, gap: str, watermark: str) -> DataFrame:
    """Times that a node was heard of without a silence longer than its lease, each once the watermark has passed its end."""
    sessions = stream.withWatermark("ts", watermark).groupBy(key, F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("beats"))
    return sessions.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "beats")


def ewma_results(stream: DataFrame, key: str, sink: str, checkpoint: str) -> None:
    """What every micro-batch does to the averages of its keys, under its number: observations are taken in the order of (ts, event_id)."""

    def write(batch: DataFrame, number: int) -> None:
        states = rolling.ewma_states(batch, [key], ["ts", "event_id"], "value")
        states.withColumn("micro_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{sink}/micro_batch_{number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ewma_merged(spark: SparkSession, sink: str, key: str) -> DataFrame:
    """(key, mean, variance, n) after all micro-batches, one after the other."""
    return rolling.ewma_after(spark.read.parquet(f"{sink}/micro_batch_*"), [key], "micro_batch")


#: Runs share so many groups, so that a group's call is paid for once for many runs. Part of the state: restarts need the same.
GROUPS = 1024
#: Places of a run that wait in one entry of the state.
CHUNK = 1024


class InOrder(StatefulProcessor):
    """Releases batches by unbroken ``place`` for all runs of a group. State: each run's next place, and chunks of those that came early."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getMapState("next", "run bigint", "place bigint")
        self.early = handle.getMapState("early", "run bigint, chunk bigint", "places array<bigint>, ids array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        arrived: dict[int, dict[int, int | None]] = {}
        for part in rows:
            for run, place, found, given in zip(part["run"].tolist(), part["place"].tolist(), part["id"].tolist(), part["given"].tolist()):
                arrived.setdefault(run, {})[place] = found if given else None
        out = [(None if key[0] < 0 else run, place, found) for run, fresh in arrived.items() for place, found in self._release(run, fresh)]
        if out:
            yield pd.DataFrame({n: pd.array(c, dtype="Int64") for n, c in zip((self.key, "place", "id"), zip(*out))})

    def _release(self, run: int, fresh: dict[int, int | None]) -> Iterator[tuple[int, int | None]]:
        before = (self.next.getValue((run,)) or (0,))[0]
        chunks: dict[int, dict[int, int | None]] = {}
        for place, found in fresh.items():
            if place >= before:  # what was released before is a replay
                chunks.setdefault(place // CHUNK, {})[place] = found
        following, at = before, before // CHUNK
        while chunks:
            # in the order of places, as far as the run is unbroken; other chunks only take up what came
            number = at if following // CHUNK == at and at in chunks else min(chunks)
            waiting = self.early.getValue((run, number))
            rest = dict(zip(*waiting)) if waiting else {}
            rest.update(chunks.pop(number))
            while following in rest:
                yield following, rest.pop(following)
                following += 1
            if rest:
                places = sorted(rest)
                self.early.updateValue((run, number), (places, [rest[p] for p in places]))
            elif waiting:
                self.early.removeKey((run, number))
            if following // CHUNK > number:  # the next chunk may have waited for this one
                at = following // CHUNK
                chunks.setdefault(at, {})
        if following > before:
            self.next.updateValue((run,), (following,))

    def close(self) -> None:
        pass


def release_in_order(stream: DataFrame, key: str) -> DataFrame:
    """(key, place, id) of completed batches in unbroken order of ``place``: one that comes early waits for those before it.

    What waits is kept by run in chunks of ``CHUNK`` places, so a change writes the chunks that it falls on and not all of
    the run. Batches without a place are never released; those without a run are a run of their own.
    """
    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(GROUPS))).cast("bigint")
    none = F.lit(0).cast("bigint")
    rows = stream.where("place is not null").select(
        group.alias("group"), F.coalesce(key, none).alias("run"), "place", F.coalesce("id", none).alias("id"), F.col("id").isNotNull().alias("given")
    )
    return rows.groupBy("group").transformWithStateInPandas(InOrder(key), f"{key} bigint, place bigint, id bigint", "append", "None")


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that the operators above need, for streams that start inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
