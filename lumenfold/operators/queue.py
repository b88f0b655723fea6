"""The work queue and run tables as queries: statistics, order, leases, claims and assignments.

Tables are append-only; a state is read off them as of a given time, never from the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.numeric import ratio
from lumenfold.operators import scan

STATUSES = ("pending", "claimed", "completed", "failed")
OPEN = ("pending", "claimed", "completed")


def work_queue_stats(batches: DataFrame, results: DataFrame) -> DataFrame:
    """Per run and status: batches, samples, mean evaluation time and mean time per sample."""
    both = batches.join(results.select(F.col("batch_id").alias("id"), "total_eval_time_ms"), "id", "left")
    return both.groupBy("run_id", "status").agg(
        F.count("*").alias("batch_count"),
        F.sum("batch_size").alias("total_samples"),
        F.avg("total_eval_time_ms").alias("avg_time_ms"),
        F.avg(F.try_divide(F.col("total_eval_time_ms"), F.col("batch_size"))).alias("avg_ms_per_sample"),
    )


def status_counts(batches: DataFrame, keys: Sequence[str] = ("run_id",), cursor: int | None = None) -> DataFrame:
    """Batches by status per key; completed ones only beyond ``cursor`` if it is given. ``open`` and ``runnable`` are sums."""
    status = F.col("status")
    done = (status == "completed") & (F.lit(True) if cursor is None else F.col("id") > cursor)
    counted = batches.groupBy(*keys).agg(
        F.count("*").alias("total_batches"),
        F.coalesce(F.sum("batch_size"), F.lit(0)).alias("total_samples"),
        *[F.count_if(done if s == "completed" else status == s).alias(f"{s}_batches") for s in STATUSES],
    )
    runnable = F.col("pending_batches") + F.col("claimed_batches")
    return counted.withColumn("runnable_batches", runnable).withColumn("open_batches", runnable + F.col("completed_batches"))


def run_progress(runs: DataFrame, batches: DataFrame, nodes: DataFrame, tasks: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per run with its lifecycle, assignments, batch counts, active task and root snapshot.

    Every joined side has one row per run, so nothing fans out.
    """
    desired = nodes.where("desired_run_id is not null").groupBy(F.col("desired_run_id").alias("run_id")).agg(F.count("*").alias("desired_assignment_count"))
    active = nodes.where("active_run_id is not null").groupBy(F.col("active_run_id").alias("run_id")).agg(F.count("*").alias("active_worker_count"))
    root = snapshots.where("queue_empty and task_id is null and sequence_nr = 0").groupBy("run_id").agg(F.max("id").alias("root_stage_snapshot_id"))
    task = tasks.where("state = 'active'").groupBy("run_id").agg(F.min("id").alias("active_task_id"))
    out = runs
    for side in (desired, active, root, task, status_counts(batches)):
        out = out.join(side, "run_id", "left")
    counts = ["desired_assignment_count", "active_worker_count", "total_batches", "total_samples", *[f"{s}_batches" for s in STATUSES]]
    out = out.fillna(0, counts)
    lifecycle = (
        F.when(F.col("desired_assignment_count") > 0, "running")
        .when((F.col("claimed_batches") > 0) | (F.col("active_worker_count") > 0), "pausing")
        .otherwise("paused")
    )
    return out.select(*runs.columns, "root_stage_snapshot_id", "active_task_id", *counts, lifecycle.alias("lifecycle_state"),
                      ratio(F.col("completed_batches"), F.col("total_batches")).alias("completion_rate"))


def completed_prefix(batches: DataFrame, limit: int, key: str = "run_id", after: Column | None = None) -> DataFrame:
    """Of each run's first ``limit`` batches beyond the cursor, those completed before the first that is not."""
    rows = batches if after is None else batches.where(F.col("id") > after)
    order = Window.partitionBy(key).orderBy("id")
    rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    behind = F.sum((F.col("status") != "completed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_behind", behind).where("_behind = 0").drop("_n", "_behind")


def completed_unseen(batches: DataFrame, processed: DataFrame, limit: int) -> DataFrame:
    """The first completed batches that were not processed, in any order of completion; none is ever passed over."""
    return batches.where("status = 'completed'").join(processed, "id", "left_anti").orderBy("id").limit(limit)


def live(nodes: DataFrame, as_of: Column) -> DataFrame:
    return nodes.where(F.col("lease_expires_at") > as_of)


def claim_next(batches: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    """The oldest pending batch of every run that has a live evaluator assigned."""
    workers = live(nodes, as_of).where("active_role = 'evaluator' and active_run_id is not null").select(F.col("active_run_id").alias("run_id"))
    head = F.row_number().over(Window.partitionBy("run_id").orderBy("created_at", "id"))
    pending = batches.where("status = 'pending'").join(workers, "run_id", "left_semi")
    return pending.withColumn("_n", head).where("_n = 1").drop("_n")


def abandoned(batches: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    """Claimed batches whose claimant is no live evaluator of that run."""
    owners = live(nodes, as_of).where("active_role = 'evaluator'").select(
        F.col("name").alias("claimed_by_node_name"), F.col("uuid").alias("claimed_by_node_uuid"), F.col("active_run_id").alias("run_id")
    )
    return batches.where("status = 'claimed'").join(owners, ["claimed_by_node_name", "claimed_by_node_uuid", "run_id"], "left_anti")


def reclaim(batches: DataFrame, nodes: DataFrame, as_of: Column) -> DataFrame:
    """The next state of all batches: abandoned ones are pending again, with one more retry."""
    lost = abandoned(batches, nodes, as_of).select("id", F.lit(True).alias("_lost"))
    out = batches.join(lost, "id", "left")
    free = lambda c: F.when(F.col("_lost"), F.lit(None)).otherwise(F.col(c)).alias(c)
    changed = {
        "status": F.when(F.col("_lost"), "pending").otherwise(F.col("status")).alias("status"),
        "retry_count": (F.col("retry_count") + F.coalesce(F.col("_lost").cast("int"), F.lit(0))).alias("retry_count"),
        "claimed_by_node_name": free("claimed_by_node_name"),
        "claimed_by_node_uuid": free("claimed_by_node_uuid"),
    }
    return out.select(*[changed.get(c, F.col(c)) for c in batches.columns])


def submit(batches: DataFrame, submissions: DataFrame) -> DataFrame:
    """Results (batch_id, node_uuid, ...) that are accepted: of a batch still claimed by that node, once each."""
    owned = batches.where("status = 'claimed'").select(F.col("id").alias("batch_id"), F.col("claimed_by_node_uuid").alias("node_uuid"))
    return submissions.join(owned, ["batch_id", "node_uuid"], "left_semi").dropDuplicates(["batch_id"])


def cleanup(batches: DataFrame, upto: int) -> DataFrame:
    """What is left once consumed completed batches are removed."""
    return batches.where(~((F.col("status") == "completed") & (F.col("id") <= upto)))


def latest_per(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def as_of_join(left: DataFrame, snapshots: DataFrame, key: str, at: str, sequence: str, payload: Sequence[str], tie: str = "id", target: int = scan.TARGET) -> DataFrame:
    """Each left row with the latest snapshot of its key strictly before it.

    Both sides are merged and the last snapshot is carried forward, within ranges of places and then from range to range, so
    there is no inequality join and a key's rows need not meet in one task. Rows are (key, at); a snapshot of the same place
    comes after the row.
    """
    packed = F.struct(F.col(sequence).alias("_seq"), F.col(tie).alias("_tie"), *payload)
    s = snapshots.select(F.col(key).alias("_k"), F.col(sequence).cast("bigint").alias("_at"), F.lit(1).alias("_side"), F.col(tie).alias("_order"), packed.alias("_snap"), F.lit(None).alias("_row"))
    rows = left.select(F.col(key).alias("_k"), F.col(at).cast("bigint").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("_order"),
                       F.lit(None).cast(s.schema["_snap"].dataType).alias("_snap"), F.struct(*left.columns).alias("_row"))
    both = rows.unionByName(s.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    found = scan.carry_last(both, ["_k"], ["_at", "_side", "_order"], "_snap", "_found", target).where("_side = 0")
    return found.select("_row.*", F.col("_found._tie").alias(f"snapshot_{tie}"), F.col("_found._seq").alias(f"snapshot_{sequence}"), *[F.col(f"_found.{p}") for p in payload])


def panel_source(tasks: DataFrame, current: DataFrame, stages: DataFrame, persisted: DataFrame, target: int = scan.TARGET) -> DataFrame:
    """What a task's panels show, as of each row of ``tasks`` (id, run_id, at, active): (id, source, source_id).

    An active task shows the run's current observable, any other the latest stage snapshot before ``at``; where that is
    missing the latest persisted snapshot before ``at``; else nothing. The histories are (id, run_id, sequence_nr).
    """
    found = tasks
    for side, history in (("current", current), ("stage", stages), ("persisted", persisted)):
        found = as_of_join(found, history, "run_id", "at", "sequence_nr", [], target=target).withColumnsRenamed({"snapshot_id": side, "snapshot_sequence_nr": f"{side}_at"})
    first = F.when(F.col("active"), F.col("current")).otherwise(F.col("stage"))
    source = F.when(first.isNotNull(), F.when(F.col("active"), "current").otherwise("stage")).when(F.col("persisted").isNotNull(), "persisted").otherwise("empty")
    return found.select("id", source.alias("source"), F.coalesce(first, F.col("persisted")).alias("source_id"))


def log_page(logs: DataFrame, limit: int, before: int | None = None, level: str | None = None, search: str | None = None, node: str | None = None) -> DataFrame:
    """A page of logs, newest first, with one row more than asked for, which tells that there are older ones."""
    if before is not None:
        logs = logs.where(F.col("id") < before)
    if level is not None:
        logs = logs.where(F.col("level") == level)
    if node is not None:
        logs = logs.where(F.col("node_name") == node)
    if search is not None:
        logs = logs.where(F.col("message").ilike(f"%{search}%") | F.col("fields").ilike(f"%{search}%"))
    return logs.orderBy(F.desc("id")).limit(limit + 1)


def log_answer(page: DataFrame, limit: int) -> DataFrame:
    """A page as it is answered: ``limit`` rows, whether older ones exist, and the id to ask with for these.

    ``page`` has one row more than asked for at most, as ``log_page`` gives it.
    """
    found = page.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("id"))))  # limit + 1 rows
    more = found.agg((F.max("_n") > limit).alias("has_more_older"), F.min(F.when(F.col("_n") <= limit, F.col("id"))).alias("_last"))
    out = found.where(F.col("_n") <= limit).join(F.broadcast(more))  # one row
    return out.withColumn("next_before_id", F.when(F.col("has_more_older"), F.col("_last"))).drop("_n", "_last")


def history(rows: DataFrame, limit: int, equal: dict | None = None) -> DataFrame:
    """The newest rows of a history (created_at, id), newest first, of what has the given values."""
    for column, value in (equal or {}).items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def claimed_inputs(claimed: DataFrame, inputs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Claimed batches (id, node_uuid, ...) with their inputs (batch_id, ...) and the name of the node, null if it is unknown."""
    names = nodes.groupBy(F.col("uuid").alias("node_uuid")).agg(F.min("name").alias("claimed_by"))
    return claimed.join(inputs.withColumnRenamed("batch_id", "id"), "id").join(names, "node_uuid", "left")


def completed_results(prefix: DataFrame, results: DataFrame) -> DataFrame:
    """Completed batches (id, ...) with their results (batch_id, ...); a batch without one is not there yet."""
    return prefix.join(results.withColumnRenamed("batch_id", "id"), "id")


def stalled(ticks: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Ticks (completed, target, open, done, produced) at which a task cannot get any further: short of its target, with nothing open, done or made."""
    stuck = (F.col("completed") < F.col("target")) & (F.col("open") == 0) & (F.col("done") == 0) & (F.col("produced") == 0)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return ticks.where(stuck).withColumn("_n", first).where("_n = 1").drop("_n")


def cloned(runs: DataFrame, snapshots: DataFrame, source: str = "run_id") -> DataFrame:
    """(run_id, from_run_id, snapshot_id) of new runs (run_id, from_run_id) at their source's latest root snapshot; tasks are not copied."""
    root = snapshots.where("queue_empty and task_id is null").groupBy(F.col(source).alias("from_run_id")).agg(F.max("id").alias("snapshot_id"))
    return runs.join(root, "from_run_id").select("run_id", "from_run_id", "snapshot_id")


def registered_workers(nodes: DataFrame, sampler: DataFrame, evaluator: DataFrame, runs: DataFrame) -> DataFrame:
    """Nodes with the latest metrics of their run and the names of the runs they serve and should serve; active first."""
    n = nodes.withColumn("run_key", F.coalesce("active_run_id", "desired_run_id"))
    for side, metric in ((sampler, "sampler_metric"), (evaluator, "evaluator_metric")):
        side = side.select(F.col("run_id").alias("run_key"), F.col("worker").alias("name"), F.col("metric").alias(metric))
        n = n.join(side, ["run_key", "name"], "left")
    for which in ("desired", "active"):
        names = runs.select(F.col("run_id").alias(f"{which}_run_id"), F.col("run_name").alias(f"{which}_run_name"))
        n = n.join(names, f"{which}_run_id", "left")
    n = n.withColumn("status", F.when(F.col("active_run_id").isNotNull(), "active").otherwise("idle"))
    return n.orderBy(F.when(F.col("status") == "active", 0).otherwise(1), F.desc_nulls_last("last_seen"), "name")


def duplicates(rows: DataFrame, keys: Sequence[str], where: str) -> DataFrame:
    """Keys that more than one matching row has: violations of a partial unique index."""
    return rows.where(where).groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def assign_free_nodes(nodes: DataFrame, runs: DataFrame, max_evaluators: int) -> DataFrame:
    """Roles for nodes without an assignment, dealt to each run of their group: the first is the sampler unless the run
    has one, the others evaluate, up to a limit."""
    free = nodes.where("desired_run_id is null")
    order = F.row_number().over(Window.partitionBy("run_id").orderBy("name"))
    dealt = free.select("run_id", "name").join(runs.select("run_id", "has_sampler"), "run_id").withColumn("n", order)
    role = F.when(~F.col("has_sampler") & (F.col("n") == 1), "sampler").otherwise("evaluator")
    place = F.col("n") - F.when(F.col("has_sampler"), 0).otherwise(1)
    return dealt.withColumn("role", role).where((F.col("role") == "sampler") | (place <= max_evaluators)).select("run_id", "name", "role")


def free_names(existing: DataFrame, prefix: str, n: int) -> DataFrame:
    """The first ``n`` of prefix-1, prefix-2, ... that are not taken."""
    spark = existing.sparkSession
    taken = existing.select("name").distinct()
    most = n + taken.where(F.col("name").startswith(f"{prefix}-")).count()
    numbered = spark.range(1, most + 1).select(F.col("id").alias("number"), F.concat(F.lit(f"{prefix}-"), F.col("id").cast("string")).alias("name"))
    return numbered.join(taken, "name", "left_anti").orderBy("number").limit(n).select("name")


def streaks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], bad: Column, least: int) -> DataFrame:
    """Maximal runs of at least ``least`` consecutive bad rows: (keys, first and last of the first order column, length)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    island = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "_bad").orderBy(*order))
    marked = rows.withColumn("_bad", bad).withColumn("_island", island).where("_bad")
    out = marked.groupBy(*keys, "_island").agg(F.min(order[-1]).alias("first_id"), F.max(order[-1]).alias("last_id"), F.count("*").alias("length"))
    return out.where(F.col("length") >= least).drop("_island")
