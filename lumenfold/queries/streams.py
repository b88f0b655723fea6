"""Streams run to their end over the events, against what a batch query gives."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lumenfold.plans.control import EWMA_ALPHA
from lumenfold.queries.registry import query, rounded, table
from lumenfold.streaming import ingest


def _folder(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lumenfold-')}"
    return f"{root.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _feed(spark: SparkSession, rows: DataFrame, name: str, run: Callable[[DataFrame], object], slices: int = 4, end: str | None = None) -> None:
    """The rows arrive in slices of consecutive times; after each, ``run`` takes up its stream where it left it.

    With ``end``, a row without values but for a time so long after the last tells the stream that no more will come: its
    watermark passes all that is still open.
    """
    folder = _folder(spark, name)
    at = F.unix_micros("ts")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    place = F.floor((at - (low or 0)) / (((high or 0) - (low or 0)) // slices + 1))
    whole = f"{folder}-whole"  # the rows are made once, not for each slice; rows without a time arrive with the last
    rows.withColumn("slice", F.coalesce(place, F.lit(slices - 1)).cast("int")).write.partitionBy("slice").parquet(whole)
    cut = spark.read.schema(StructType([*rows.schema.fields, StructField("slice", IntegerType())])).parquet(whole)
    for k in range(slices):
        cut.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(folder)
        run(ingest.read_stream(spark, folder, rows.schema))
    if end is not None:
        closing = rows.agg((F.max("ts") + F.expr(f"interval {end}")).alias("ts"))
        closing.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]).write.mode("append").parquet(folder)
        run(ingest.read_stream(spark, folder, rows.schema))


def _drain(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _appended(spark: SparkSession, out: str, name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], object]:
    state = _folder(spark, name)
    return lambda s: _drain(operator(s).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT event_type, count(*) AS count, round(sum(value / 100 * 1.5), 6) AS sum_weighted_value, round(sum(value / 100 * 1.5), 6) AS sum_abs,
  round(sum(value / 100 * 1.5 * value / 100 * 1.5), 6) AS sum_sq, 0::BIGINT AS nan_count FROM events GROUP BY 1""")
def stream_ingest(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "ts", "event_type", F.col("event_id").alias("batch_id"), (F.col("value") / 100).alias("value"), F.lit(-1.5).alias("weight"))
    sink = _folder(spark, "states")
    done = _folder(spark, "ingest")
    _feed(spark, rows, "results", lambda s: ingest.merge_results(s, ["event_type"], sink, done))
    return rounded(ingest.merged(spark, sink, ["event_type"]))


@query(f"""WITH o AS (SELECT user_id, list(value ORDER BY ts, event_id) AS xs FROM events GROUP BY 1),
s AS (SELECT user_id, len(xs) AS n, list_reduce(list_transform(xs, lambda x: {{'m': x, 'v': 0.0::DOUBLE}}),
  lambda a, e: {{'m': a.m + {EWMA_ALPHA} * (e.m - a.m), 'v': greatest(0.0, (1 - {EWMA_ALPHA}) * (a.v + {EWMA_ALPHA} * (e.m - a.m) * (e.m - a.m)))}}) AS r FROM o)
SELECT user_id, round(r.m, 6) AS mean, round(r.v, 6) AS variance, n::BIGINT AS n FROM s""")
def stream_ewma(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "ts", "user_id", "value")
    sink = _folder(spark, "ewma")
    done = _folder(spark, "ewma-state")
    _feed(spark, rows, "metrics", lambda s: ingest.ewma_results(s, "user_id", sink, done))
    return rounded(ingest.ewma_merged(spark, sink, "user_id"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m),
g AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS beats FROM s GROUP BY user_id, k)
SELECT user_id, epoch_us(a) AS start_us, beats FROM g""")
def stream_lease_sessions(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "ts", "user_id")
    out = _folder(spark, "sessions")
    run = _appended(spark, out, "session-state", lambda s: ingest.lease_sessions(s, "user_id", "12 hours", "1 hour"))
    _feed(spark, rows, "beats", run, end="30 days")
    return spark.read.schema("user_id bigint, start timestamp, end timestamp, beats bigint").parquet(out).select("user_id", F.unix_micros("start").alias("start_us"), "beats")


@query("""WITH p AS (SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, event_id % 60 = 59 AS lost FROM events),
f AS (SELECT user_id, min(place) FILTER (lost) AS first FROM p GROUP BY 1) SELECT user_id, place, id FROM p JOIN f USING (user_id) WHERE NOT lost AND (first IS NULL OR place < first)""")
def stream_in_order(spark, sf_dir):
    e = _events(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = e.select("user_id", F.col("event_id").alias("id"), place.cast("bigint").alias("place"), F.col("ts"), F.hash("event_id").alias("event_id")).where("id % 60 <> 59")
    # batches complete out of order: slices are cut by a hash instead of time
    rows = rows.withColumn("ts", F.timestamp_seconds(F.pmod("event_id", F.lit(1000))))
    out = _folder(spark, "ordered")
    with ingest.keyed_state(spark):
        _feed(spark, rows, "completed", _appended(spark, out, "order-state", lambda s: ingest.release_in_order(s, "user_id")))
    return spark.read.schema("user_id bigint, place bigint, id bigint").parquet(out)
