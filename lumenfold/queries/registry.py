"""The register of queries, and the run tables that the star schema's tables stand for.

events are batches with their results, nation holds the nodes, orders the tasks and stage snapshots, lineitem
weighted samples, conversations the logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "2024-01-31 00:00:00"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "click", "pending").when(kind == "view", "claimed").when(kind == "error", "failed").otherwise("completed")
    node = (F.col("user_id") % 25).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 10).cast("int").alias("run_id"), F.col("user_id").alias("task_id"), status.alias("status"),
        (16 + F.col("event_id") % 49).cast("int").alias("batch_size"), F.col("ts").alias("created_at"), F.col("value").alias("total_eval_time_ms"),
        F.concat(F.lit("node-"), node).alias("claimed_by_node_name"), F.concat(F.lit("uuid-"), node).alias("claimed_by_node_uuid"),
        (F.col("event_id") % 3).cast("int").alias("retry_count"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    run = (k % 10).cast("int")
    minute = lambda x: (F.lit(AS_OF).cast("timestamp_ntz") + F.make_dt_interval(mins=x)).cast("timestamp_ntz")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("node-"), k.cast("string")).alias("name"), F.concat(F.lit("uuid-"), k.cast("string")).alias("uuid"),
        F.when(k % 3 != 0, run).alias("desired_run_id"), F.when(k % 4 != 0, run).alias("active_run_id"),
        F.when(k % 5 == 0, "sampler").otherwise("evaluator").alias("active_role"),
        minute(k - 12).alias("lease_expires_at"), F.when(k % 7 != 0, minute(-k)).alias("last_seen"),
    )


def runs(spark: SparkSession) -> DataFrame:
    return spark.range(12).select(F.col("id").cast("int").alias("run_id"), F.concat(F.lit("run-"), F.col("id").cast("string")).alias("run_name"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).cast("int").alias("run_id"), (F.col("o_orderkey") % 50).cast("int").alias("sequence_nr"),
        F.when(s == "P", "active").when(s == "F", "completed").otherwise("pending").alias("state"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), (F.col("o_custkey") % 10).cast("int").alias("run_id"), F.when(k % 100 != 7, k * 7 % 5000).cast("int").alias("sequence_nr"),
        (F.col("o_orderstatus") != "P").alias("queue_empty"), F.when(k % 500 != 0, k).alias("task_id"),
    )


# the same tables for DuckDB
BATCHES = """b AS (SELECT event_id AS id, CAST(user_id % 10 AS INT) AS run_id, user_id AS task_id,
  CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'claimed' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
  CAST(16 + event_id % 49 AS INT) AS batch_size, ts AS created_at, value AS total_eval_time_ms,
  'node-' || (user_id % 25) AS claimed_by_node_name, 'uuid-' || (user_id % 25) AS claimed_by_node_uuid,
  CAST(event_id % 3 AS INT) AS retry_count FROM events)"""
NODES = f"""nd AS (SELECT 'node-' || n_nationkey AS name, 'uuid-' || n_nationkey AS uuid,
  CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey % 10 AS INT) END AS desired_run_id,
  CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey % 10 AS INT) END AS active_run_id,
  CASE WHEN n_nationkey % 5 = 0 THEN 'sampler' ELSE 'evaluator' END AS active_role,
  TIMESTAMP '{AS_OF}' + to_minutes(n_nationkey - 12) AS lease_expires_at,
  CASE WHEN n_nationkey % 7 <> 0 THEN TIMESTAMP '{AS_OF}' - to_minutes(n_nationkey) END AS last_seen FROM nation)"""
RUNS = "rn AS (SELECT CAST(range AS INT) AS run_id, 'run-' || range AS run_name FROM range(12))"
TASKS = """tk AS (SELECT o_orderkey AS id, CAST(o_custkey % 10 AS INT) AS run_id, CAST(o_orderkey % 50 AS INT) AS sequence_nr,
  CASE o_orderstatus WHEN 'P' THEN 'active' WHEN 'F' THEN 'completed' ELSE 'pending' END AS state FROM orders)"""
SNAPSHOTS = """sn AS (SELECT o_orderkey AS id, CAST(o_custkey % 10 AS INT) AS run_id,
  CASE WHEN o_orderkey % 100 <> 7 THEN CAST(o_orderkey * 7 % 5000 AS INT) END AS sequence_nr,
  o_orderstatus <> 'P' AS queue_empty, CASE WHEN o_orderkey % 500 <> 0 THEN o_orderkey END AS task_id FROM orders)"""
