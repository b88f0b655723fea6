"""Queue, run and node queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.functions.display import clone_name, default_name
from lumenfold.functions.numeric import ratio
from lumenfold.operators import queue, rolling
from lumenfold.plans import control
from lumenfold.plans.control import EWMA_ALPHA
from lumenfold.queries.registry import AS_OF, BATCHES, NODES, RUNS, SNAPSHOTS, TASKS, batches, nodes, query, rounded, runs, snapshots, table, tasks
from lumenfold.sources.state import batch_ids, log_rows


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query(f"""WITH {BATCHES}, r AS (SELECT id AS batch_id, total_eval_time_ms AS t FROM b WHERE status IN ('completed', 'failed'))
SELECT run_id, status, count(*) AS batch_count, CAST(sum(batch_size) AS BIGINT) AS total_samples, round(avg(t), 6) AS avg_time_ms,
  round(avg(t / nullif(batch_size, 0)), 6) AS avg_ms_per_sample FROM b LEFT JOIN r ON r.batch_id = b.id GROUP BY run_id, status""")
def queue_stats(spark, sf_dir):
    b = batches(spark, sf_dir)
    results = b.where("status in ('completed', 'failed')").select(F.col("id").alias("batch_id"), "total_eval_time_ms")
    return rounded(queue.work_queue_stats(b.drop("total_eval_time_ms"), results))


@query(f"""WITH {BATCHES} SELECT run_id, count(*) AS total_batches, CAST(coalesce(sum(batch_size), 0) AS BIGINT) AS total_samples,
  count(*) FILTER (status = 'pending') AS pending_batches, count(*) FILTER (status = 'claimed') AS claimed_batches,
  count(*) FILTER (status = 'completed' AND id > 500) AS completed_batches, count(*) FILTER (status = 'failed') AS failed_batches,
  count(*) FILTER (status IN ('pending', 'claimed')) AS runnable_batches,
  count(*) FILTER (status IN ('pending', 'claimed') OR (status = 'completed' AND id > 500)) AS open_batches FROM b GROUP BY run_id""")
def queue_counts(spark, sf_dir):
    return queue.status_counts(batches(spark, sf_dir), cursor=500)


@query(f"""WITH {BATCHES}, {NODES}, {RUNS}, {TASKS}, {SNAPSHOTS},
d AS (SELECT desired_run_id AS run_id, count(*) AS n FROM nd WHERE desired_run_id IS NOT NULL GROUP BY 1),
a AS (SELECT active_run_id AS run_id, count(*) AS n FROM nd WHERE active_run_id IS NOT NULL GROUP BY 1),
s AS (SELECT run_id, max(id) AS id FROM sn WHERE queue_empty AND task_id IS NULL AND sequence_nr = 0 GROUP BY 1),
t AS (SELECT run_id, min(id) AS id FROM tk WHERE state = 'active' GROUP BY 1),
c AS (SELECT run_id, count(*) AS total, sum(batch_size) AS samples, count(*) FILTER (status = 'pending') AS p, count(*) FILTER (status = 'claimed') AS cl,
  count(*) FILTER (status = 'completed') AS co, count(*) FILTER (status = 'failed') AS f FROM b GROUP BY 1)
SELECT rn.run_id, rn.run_name, s.id AS root_stage_snapshot_id, t.id AS active_task_id, coalesce(d.n, 0) AS desired_assignment_count,
  coalesce(a.n, 0) AS active_worker_count, coalesce(c.total, 0) AS total_batches, CAST(coalesce(c.samples, 0) AS BIGINT) AS total_samples,
  coalesce(c.p, 0) AS pending_batches, coalesce(c.cl, 0) AS claimed_batches, coalesce(c.co, 0) AS completed_batches, coalesce(c.f, 0) AS failed_batches,
  CASE WHEN coalesce(d.n, 0) > 0 THEN 'running' WHEN coalesce(c.cl, 0) > 0 OR coalesce(a.n, 0) > 0 THEN 'pausing' ELSE 'paused' END AS lifecycle_state,
  round(CASE WHEN coalesce(c.total, 0) > 0 THEN c.co / c.total ELSE 0.0 END, 6) AS completion_rate
FROM rn LEFT JOIN d USING (run_id) LEFT JOIN a USING (run_id) LEFT JOIN s USING (run_id) LEFT JOIN t USING (run_id) LEFT JOIN c USING (run_id)""")
def run_progress(spark, sf_dir):
    return rounded(queue.run_progress(runs(spark), batches(spark, sf_dir), nodes(spark, sf_dir), tasks(spark, sf_dir), snapshots(spark, sf_dir)))


@query(f"""WITH {BATCHES}, c AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY id) AS n FROM b WHERE id > 100 AND status <> 'failed'),
k AS (SELECT * FROM c WHERE n <= 16), f AS (SELECT task_id, min(id) FILTER (status <> 'completed') AS first FROM k GROUP BY 1)
SELECT k.task_id, k.id, k.batch_size FROM k JOIN f USING (task_id) WHERE k.status = 'completed' AND (f.first IS NULL OR k.id < f.first)""")
def completed_prefix(spark, sf_dir):
    b = batches(spark, sf_dir).where("status <> 'failed'")
    return queue.completed_prefix(b, 16, "task_id", F.lit(100)).select("task_id", "id", "batch_size")


@query(f"WITH {BATCHES} SELECT id, run_id, batch_size FROM b WHERE status = 'completed' AND id % 5 <> 0 ORDER BY id LIMIT 200")
def completed_unordered(spark, sf_dir):
    b = batches(spark, sf_dir)
    return queue.completed_unseen(b, b.where("id % 5 = 0").select("id"), 200).select("id", "run_id", "batch_size")


@query(f"""WITH {BATCHES}, {NODES} SELECT run_id, id, batch_size FROM b WHERE status = 'pending' AND EXISTS (SELECT 1 FROM nd WHERE
  nd.active_run_id = b.run_id AND nd.active_role = 'evaluator' AND nd.lease_expires_at > TIMESTAMP '{AS_OF}')
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at, id) = 1""")
def claim_next(spark, sf_dir):
    return queue.claim_next(batches(spark, sf_dir), nodes(spark, sf_dir), _as_of()).select("run_id", "id", "batch_size")


_ABANDONED = f"""status = 'claimed' AND NOT EXISTS (SELECT 1 FROM nd WHERE nd.name = b.claimed_by_node_name AND nd.uuid = b.claimed_by_node_uuid
  AND nd.active_run_id = b.run_id AND nd.active_role = 'evaluator' AND nd.lease_expires_at > TIMESTAMP '{AS_OF}')"""


@query(f"WITH {BATCHES}, {NODES} SELECT id, run_id, claimed_by_node_name FROM b WHERE {_ABANDONED}")
def reclaim_abandoned(spark, sf_dir):
    return queue.abandoned(batches(spark, sf_dir), nodes(spark, sf_dir), _as_of()).select("id", "run_id", "claimed_by_node_name")


@query(f"""WITH {BATCHES}, {NODES}, l AS (SELECT *, {_ABANDONED} AS lost FROM b)
SELECT CASE WHEN lost THEN 'pending' ELSE status END AS status, count(*) AS batches, CAST(sum(retry_count + lost::INT) AS BIGINT) AS retries,
  count(CASE WHEN NOT lost THEN claimed_by_node_name END) AS owned FROM l GROUP BY 1""")
def reclaim_next_state(spark, sf_dir):
    after = queue.reclaim(batches(spark, sf_dir), nodes(spark, sf_dir), _as_of())
    return after.groupBy("status").agg(F.count("*").alias("batches"), F.sum("retry_count").alias("retries"), F.count("claimed_by_node_name").alias("owned"))


@query(f"""WITH {BATCHES} SELECT run_id, count(*) AS accepted FROM b WHERE status = 'claimed' AND id % 4 <> 0 GROUP BY 1""")
def submit_fencing(spark, sf_dir):
    b = batches(spark, sf_dir)
    stale = F.when(F.col("id") % 4 == 0, "uuid-gone").otherwise(F.col("claimed_by_node_uuid")).alias("node_uuid")
    sent = b.select(F.col("id").alias("batch_id"), stale, F.col("run_id"))
    return queue.submit(b, sent.union(sent)).groupBy("run_id").agg(F.count("*").alias("accepted"))


@query(f"WITH {BATCHES} SELECT status, count(*) AS left_batches FROM b WHERE NOT (status = 'completed' AND id <= 5000) GROUP BY 1")
def consumed_cleanup(spark, sf_dir):
    return queue.cleanup(batches(spark, sf_dir), 5000).groupBy("status").agg(F.count("*").alias("left_batches"))


@query("""SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_worker(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return queue.latest_per(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("""WITH l AS (SELECT event_type, user_id, value, CASE WHEN event_id % 7 <> 0 THEN value / 10 END AS idle FROM events
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT event_type, count(*) AS workers, round(avg(value), 6) AS avg_value, round(avg(coalesce(idle, 0)), 6) AS avg_idle FROM l GROUP BY 1""")
def fleet_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("idle", F.when(F.col("event_id") % 7 != 0, F.col("value") / 10))
    return rounded(rolling.fleet_summary(rows, ["event_type"], "user_id", [F.desc("ts"), F.desc("event_id")], ["value", "idle"]))


_LOGS = """lg AS (SELECT conv_id * 100 + turn AS id, role AS level, text AS message, '{"turn": ' || turn || '}' AS fields, 'node-' || (conv_id % 5) AS node_name
  FROM conversations)"""


def _logs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    fields = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}"))
    node = F.concat(F.lit("node-"), (F.col("conv_id") % 5).cast("string"))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("level"), F.col("text").alias("message"), fields.alias("fields"), node.alias("node_name"))


@query(f"""WITH {_LOGS} SELECT id, level, node_name FROM lg WHERE id < 8000 AND level = 'assistant' AND (message ILIKE '%the%' OR fields ILIKE '%the%')
  ORDER BY id DESC LIMIT 51""")
def log_page(spark, sf_dir):
    return queue.log_page(_logs(spark, sf_dir), 50, before=8000, level="assistant", search="the").select("id", "level", "node_name")


@query(f"WITH {_LOGS} SELECT id, node_name FROM lg WHERE node_name = 'node-2' ORDER BY id DESC LIMIT 26")
def log_page_of_node(spark, sf_dir):
    return queue.log_page(_logs(spark, sf_dir), 25, node="node-2").select("id", "node_name")


@query(f"""WITH {_LOGS}, p AS (SELECT id, level, row_number() OVER (ORDER BY id DESC) AS n FROM lg WHERE level = 'user'), a AS (SELECT * FROM p WHERE n <= 40)
SELECT id, level, (SELECT count(*) > 40 FROM p) AS has_more_older, (SELECT min(id) FROM a WHERE (SELECT count(*) > 40 FROM p)) AS next_before_id FROM a""")
def log_answer(spark, sf_dir):
    """A page of logs with what is needed to ask for the next."""
    n = control.page_limit(40)
    return queue.log_answer(queue.log_page(_logs(spark, sf_dir), n, level="user"), n).select("id", "level", "has_more_older", "next_before_id")


@query("""WITH l AS (SELECT conv_id * 100 + turn AS id, role AS source, CASE turn % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN 'debug' WHEN 2 THEN 'WARN' ELSE 'noise' END AS level, conv_id, turn FROM conversations)
SELECT id, source, CASE level WHEN 'noise' THEN 'noise' ELSE lower(level) END AS level, conv_id::VARCHAR AS conv, 'own' AS kind, CASE WHEN turn % 3 = 0 THEN NULL ELSE turn::VARCHAR END AS turn
FROM l WHERE (source = 'user' AND level = 'WARN') OR (source <> 'user' AND level <> 'debug')""")
def log_sink(spark, sf_dir):
    """Log rows of a level policy, with the fields of their span under their own."""
    turn = F.col("turn")
    level = F.when(turn % 4 == 0, "INFO").when(turn % 4 == 1, "debug").when(turn % 4 == 2, "WARN").otherwise("noise")
    text = lambda c: F.col(c).cast("string")
    own = F.when(turn % 3 == 0, F.create_map(F.lit("kind"), F.lit("own"))).otherwise(F.create_map(F.lit("kind"), F.lit("own"), F.lit("turn"), text("turn")))
    span = F.create_map(F.lit("kind"), F.lit("span"), F.lit("conv"), text("conv_id"))
    events = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + turn).alias("id"), F.col("role").alias("source"), level.alias("level"), span.alias("span"), own.alias("fields"))
    rows = log_rows(events, "info", {"user": "warn"})
    return rows.select("id", "source", "level", *[F.col("fields")[k].alias(k) for k in ("conv", "kind", "turn")])


@query(f"""WITH {BATCHES} SELECT id, created_at, total_eval_time_ms FROM b WHERE claimed_by_node_name = 'node-3' ORDER BY created_at DESC, id DESC LIMIT 64""")
def performance_history(spark, sf_dir):
    """The newest measurements of one worker."""
    return queue.history(batches(spark, sf_dir), 64, {"claimed_by_node_name": "node-3"}).select("id", "created_at", "total_eval_time_ms")


@query(f"""WITH {BATCHES}, {NODES}, c AS (SELECT id, run_id, claimed_by_node_uuid AS node_uuid FROM b WHERE status = 'claimed')
SELECT c.id, c.run_id, 16 + c.id % 7 AS nr_samples, nd.name AS claimed_by FROM c LEFT JOIN nd ON nd.uuid = c.node_uuid AND nd.uuid NOT LIKE '%9' WHERE c.id % 3 <> 0""")
def claimed_inputs(spark, sf_dir):
    """Claimed batches with their inputs and their node's name, where the node is known."""
    claimed = batches(spark, sf_dir).where("status = 'claimed'").select("id", "run_id", F.col("claimed_by_node_uuid").alias("node_uuid"))
    inputs = table(spark, sf_dir, "events").where("event_id % 3 <> 0").select(F.col("event_id").alias("batch_id"), (16 + F.col("event_id") % 7).alias("nr_samples"))
    found = queue.claimed_inputs(claimed, inputs, nodes(spark, sf_dir).where("uuid not like '%9'"))
    return found.select("id", "run_id", "nr_samples", "claimed_by")


@query(f"""WITH {BATCHES}, c AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY id) AS n FROM b WHERE status <> 'failed'), k AS (SELECT * FROM c WHERE n <= 8),
f AS (SELECT task_id, min(id) FILTER (status <> 'completed') AS first FROM k GROUP BY 1)
SELECT k.task_id, k.id, k.total_eval_time_ms AS ms FROM k JOIN f USING (task_id) WHERE k.status = 'completed' AND (f.first IS NULL OR k.id < f.first) AND k.id % 5 <> 0""")
def completed_results(spark, sf_dir):
    """The results of each task's completed prefix, where they have come."""
    b = batches(spark, sf_dir)
    prefix = queue.completed_prefix(b.where("status <> 'failed'"), 8, "task_id").select("task_id", "id")
    results = b.where("id % 5 <> 0").select(F.col("id").alias("batch_id"), F.col("total_eval_time_ms").alias("ms"))
    return queue.completed_results(prefix, results).select("task_id", "id", "ms")


@query("""SELECT user_id, min(event_id) AS event_id FROM events WHERE event_id % 90 < 80 AND event_id % 2 = 0 AND event_type = 'view' AND user_id % 3 = 0 GROUP BY 1""")
def no_progress(spark, sf_dir):
    """The first tick at which each task is stuck."""
    i, kind = F.col("event_id"), F.col("event_type")
    ticks = table(spark, sf_dir, "events").select("user_id", "event_id", (i % 90).alias("completed"), F.lit(80).alias("target"), (i % 2).alias("open"),
                                                  (kind != "view").cast("int").alias("done"), (F.col("user_id") % 3).alias("produced"))
    return queue.stalled(ticks, ["user_id"], ["event_id"]).select("user_id", "event_id")


@query(f"""WITH {SNAPSHOTS} SELECT (100 + run_id)::INT AS run_id, run_id AS from_run_id, max(id) AS snapshot_id FROM sn WHERE queue_empty AND task_id IS NULL GROUP BY run_id""")
def cloned_runs(spark, sf_dir):
    wanted = runs(spark).select((100 + F.col("run_id")).alias("run_id"), F.col("run_id").alias("from_run_id"))
    return queue.cloned(wanted, snapshots(spark, sf_dir))


@query("SELECT event_id, user_id FROM events WHERE user_id = 7 AND event_id > 300 ORDER BY event_id DESC LIMIT 40")
def snapshot_delta(spark, sf_dir):
    return table(spark, sf_dir, "events").where("user_id = 7 and event_id > 300").orderBy(F.desc("event_id")).limit(40).select("event_id", "user_id")


@query(f"""WITH {TASKS}, {SNAPSHOTS}, ok AS (SELECT * FROM sn WHERE queue_empty AND sequence_nr IS NOT NULL),
g AS (SELECT id, run_id, sequence_nr * 100 AS at FROM tk WHERE state = 'active'),
m AS (SELECT g.id, g.run_id, g.at, s.id AS snapshot_id, s.sequence_nr AS snapshot_sequence_nr FROM g LEFT JOIN ok s ON s.run_id = g.run_id AND s.sequence_nr < g.at)
SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_sequence_nr DESC NULLS LAST, snapshot_id DESC NULLS LAST) = 1""")
def stage_asof(spark, sf_dir):
    left = tasks(spark, sf_dir).where("state = 'active'").select("id", "run_id", (F.col("sequence_nr") * 100).alias("at"))
    right = snapshots(spark, sf_dir).where("queue_empty and sequence_nr is not null")
    return queue.as_of_join(left, right, "run_id", "at", "sequence_nr", [])


@query(f"""WITH {TASKS}, {SNAPSHOTS}, {BATCHES}, g AS (SELECT id, run_id, sequence_nr * 100 AS at, state = 'active' AS active FROM tk),
cu AS (SELECT id, run_id, id % 5000 AS s FROM b WHERE status = 'claimed' AND run_id < 5), st AS (SELECT id, run_id, sequence_nr AS s FROM sn WHERE queue_empty AND run_id % 2 = 0),
pe AS (SELECT id, run_id, 1000 + id % 4000 AS s FROM b WHERE status = 'completed' AND run_id < 8),
f AS (SELECT g.*, (SELECT arg_max(x.id, x.s::BIGINT * 1000000000 + x.id) FROM cu x WHERE x.run_id = g.run_id AND x.s < g.at) AS c,
  (SELECT arg_max(x.id, x.s::BIGINT * 1000000000 + x.id) FROM st x WHERE x.run_id = g.run_id AND x.s < g.at) AS s,
  (SELECT arg_max(x.id, x.s::BIGINT * 1000000000 + x.id) FROM pe x WHERE x.run_id = g.run_id AND x.s < g.at) AS p FROM g)
SELECT id, CASE WHEN active AND c IS NOT NULL THEN 'current' WHEN NOT active AND s IS NOT NULL THEN 'stage' WHEN p IS NOT NULL THEN 'persisted' ELSE 'empty' END AS source,
  coalesce(CASE WHEN active THEN c ELSE s END, p) AS source_id FROM f""")
def panel_sources(spark, sf_dir):
    """What each task's panels show: the current observable, a stage, a persisted snapshot, or nothing."""
    t = tasks(spark, sf_dir).select("id", "run_id", (F.col("sequence_nr") * 100).alias("at"), (F.col("state") == "active").alias("active"))
    b = batches(spark, sf_dir)
    current = b.where("status = 'claimed' and run_id < 5").select("id", "run_id", (F.col("id") % 5000).alias("sequence_nr"))
    persisted = b.where("status = 'completed' and run_id < 8").select("id", "run_id", (1000 + F.col("id") % 4000).alias("sequence_nr"))
    stages = snapshots(spark, sf_dir).where("queue_empty and run_id % 2 = 0 and sequence_nr is not null").select("id", "run_id", "sequence_nr")
    return queue.panel_source(t, current, stages, persisted)


@query(f"""WITH {BATCHES}, {NODES}, {RUNS}, m AS (SELECT run_id, claimed_by_node_name AS worker, total_eval_time_ms AS metric, status FROM b
  QUALIFY row_number() OVER (PARTITION BY run_id, claimed_by_node_name, status ORDER BY created_at DESC, id DESC) = 1)
SELECT nd.name, coalesce(nd.active_run_id, nd.desired_run_id) AS run_key, s.metric AS sampler_metric, e.metric AS evaluator_metric,
  d.run_name AS desired_run_name, a.run_name AS active_run_name, CASE WHEN nd.active_run_id IS NOT NULL THEN 'active' ELSE 'idle' END AS status
FROM nd LEFT JOIN m s ON s.run_id = coalesce(nd.active_run_id, nd.desired_run_id) AND s.worker = nd.name AND s.status = 'claimed'
LEFT JOIN m e ON e.run_id = coalesce(nd.active_run_id, nd.desired_run_id) AND e.worker = nd.name AND e.status = 'completed'
LEFT JOIN rn d ON d.run_id = nd.desired_run_id LEFT JOIN rn a ON a.run_id = nd.active_run_id""")
def registered_workers(spark, sf_dir):
    b = batches(spark, sf_dir).select("run_id", F.col("claimed_by_node_name").alias("worker"), F.col("total_eval_time_ms").alias("metric"), "status", "created_at", "id")
    latest = queue.latest_per(b, ["run_id", "worker", "status"], [F.desc("created_at"), F.desc("id")])
    out = queue.registered_workers(nodes(spark, sf_dir), latest.where("status = 'claimed'"), latest.where("status = 'completed'"), runs(spark))
    return out.select("name", "run_key", "sampler_metric", "evaluator_metric", "desired_run_name", "active_run_name", "status")


@query(f"WITH {NODES} SELECT active_run_id, active_role, count(*) AS rows FROM nd WHERE active_run_id IS NOT NULL AND active_role = 'sampler' GROUP BY 1, 2 HAVING count(*) > 1")
def unique_sampler_violation(spark, sf_dir):
    return queue.duplicates(nodes(spark, sf_dir), ["active_run_id", "active_role"], "active_run_id is not null and active_role = 'sampler'")


@query(f"WITH {TASKS} SELECT run_id, count(*) AS rows FROM tk WHERE state = 'active' GROUP BY 1 HAVING count(*) > 1")
def one_active_task_violation(spark, sf_dir):
    return queue.duplicates(tasks(spark, sf_dir), ["run_id"], "state = 'active'")


@query(f"WITH {TASKS} SELECT run_id, coalesce(max(sequence_nr), 0) + 1 AS next_sequence, max(id) AS latest_id FROM tk GROUP BY 1")
def task_next_sequence(spark, sf_dir):
    return tasks(spark, sf_dir).groupBy("run_id").agg((F.coalesce(F.max("sequence_nr"), F.lit(0)) + 1).alias("next_sequence"), F.max("id").alias("latest_id"))


@query(f"""WITH {TASKS}, {SNAPSHOTS}, m AS (SELECT task_id, max(id) AS latest FROM sn WHERE queue_empty GROUP BY 1)
SELECT tk.id, tk.state, coalesce(m.latest, -1) AS latest_snapshot FROM tk LEFT JOIN m ON m.task_id = tk.id""")
def task_latest_snapshot(spark, sf_dir):
    latest = snapshots(spark, sf_dir).where("queue_empty").groupBy(F.col("task_id").alias("id")).agg(F.max("id").alias("latest_snapshot"))
    return tasks(spark, sf_dir).join(latest, "id", "left").select("id", "state", F.coalesce("latest_snapshot", F.lit(-1).cast("bigint")).alias("latest_snapshot"))


@query("""WITH f AS (SELECT n_regionkey AS run_id, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS n FROM nation
  WHERE n_nationkey % 3 = 0), r AS (SELECT r_regionkey AS run_id, r_regionkey % 2 = 0 AS has_sampler FROM region)
SELECT run_id, name, CASE WHEN NOT has_sampler AND n = 1 THEN 'sampler' ELSE 'evaluator' END AS role FROM f JOIN r USING (run_id)
WHERE (NOT has_sampler AND n = 1) OR n - (CASE WHEN has_sampler THEN 0 ELSE 1 END) <= 1""")
def free_nodes_assign(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    free = n.select(F.col("n_regionkey").alias("run_id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 != 0, 1).alias("desired_run_id"))
    has = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("run_id"), (F.col("r_regionkey") % 2 == 0).alias("has_sampler"))
    return queue.assign_free_nodes(free, has, 1)


@query("""WITH t AS (SELECT 'w-' || s_suppkey AS name FROM supplier WHERE s_suppkey % 3 <> 1)
SELECT 'w-' || range AS name FROM range(1, 2000) WHERE 'w-' || range NOT IN (SELECT name FROM t) ORDER BY range LIMIT 20""")
def free_worker_names(spark, sf_dir):
    taken = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 1").select(F.concat(F.lit("w-"), F.col("s_suppkey").cast("string")).alias("name"))
    return queue.free_names(taken, "w", 20)


@query("""WITH m AS (SELECT user_id, event_id, event_type IN ('error', 'view') AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
i AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, bad ORDER BY n) AS island FROM m)
SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS length FROM i WHERE bad GROUP BY user_id, island HAVING count(*) >= 3""")
def failure_streaks(spark, sf_dir):
    return queue.streaks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "view"), 3)


@query("""WITH g AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
SELECT user_id, event_id, CAST(round(epoch_us(next) / 1000000.0 - epoch_us(ts) / 1000000.0) AS BIGINT) AS silent_s FROM g WHERE next > ts + INTERVAL 1 DAY""")
def lease_gaps(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("next").cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf_dir, "events").withColumn("next", F.lead("ts").over(w)).where("next > ts + interval 1 day")
    return rows.select("user_id", "event_id", F.round(gap).cast("bigint").alias("silent_s"))


@query("SELECT event_id, ((epoch_us(ts) // 1000) << 22) | ((user_id % 65536) << 6) | (event_id % 64) AS batch_id FROM events")
def sortable_batch_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", batch_ids(F.unix_millis(F.col("ts").cast("timestamp")), F.col("user_id"), F.col("event_id")).alias("batch_id"))


@query(f"""WITH o AS (SELECT user_id, list(value ORDER BY ts, event_id) AS xs FROM events GROUP BY 1),
s AS (SELECT user_id, len(xs) AS n, list_reduce(list_transform(xs, lambda x: {{'m': x, 'v': 0.0::DOUBLE}}),
  lambda a, e: {{'m': a.m + {EWMA_ALPHA} * (e.m - a.m), 'v': greatest(0.0, (1 - {EWMA_ALPHA}) * (a.v + {EWMA_ALPHA} * (e.m - a.m) * (e.m - a.m)))}}) AS r FROM o)
SELECT user_id, round(r.m, 6) AS mean, round(r.v, 6) AS variance, n::BIGINT AS n FROM s""")
def ewma_metric(spark, sf_dir):
    return rounded(rolling.ewma(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value"))


@query("""WITH c AS (SELECT user_id, event_id, ts, sum(event_id % 40) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS done FROM events),
l AS (SELECT *, lag(done) OVER w AS before, lag(ts) OVER w AS earlier FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(CASE WHEN epoch_us(ts) = epoch_us(earlier) THEN NULL ELSE greatest((done - before)::DOUBLE / ((epoch_us(ts) - epoch_us(earlier)) / 1000000.0), 0.0) END, 6) AS throughput
FROM l WHERE before IS NOT NULL""")
def throughput(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "events").withColumn("done", F.sum(F.col("event_id") % 40).over(w))
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    out = rolling.throughput(rows, ["user_id"], ["ts", "event_id"], "done", "ts").withColumn("n", first)
    return rounded(out.where("n > 1").select("user_id", "event_id", "throughput"))


@query(f"""WITH {BATCHES} SELECT run_id, round(coalesce(count(*) FILTER (status = 'completed') / nullif(count(*), 0), 0), 6) AS completion,
  round(coalesce(count(*) FILTER (status = 'failed')::DOUBLE / nullif(count(*) FILTER (status IN ('completed', 'failed')), 0), 0), 6) AS failures FROM b GROUP BY 1""")
def ratio_metrics(spark, sf_dir):
    b = batches(spark, sf_dir).groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("c"), F.count_if(F.col("status") == "failed").alias("f")
    )
    return rounded(b.select("run_id", ratio(F.col("c"), F.col("n")).alias("completion"), ratio(F.col("f"), F.col("c") + F.col("f")).alias("failures")))


@query("""WITH s AS (SELECT event_id, unnest([{'k': 'fetch', 'v': value}, {'k': 'evaluate', 'v': value * 3 - 20},
  {'k': 'submit', 'v': CASE WHEN event_id % 11 = 0 THEN 'inf'::DOUBLE ELSE value / 4 END}]) AS s FROM events),
g AS (SELECT event_id, s.k AS segment, s.v AS ms FROM s WHERE isfinite(s.v) AND s.v > 0)
SELECT event_id, segment, round(ms, 6) AS ms, round(sum(ms) OVER (PARTITION BY event_id), 6) AS total_ms FROM g""")
def tick_breakdown(spark, sf_dir):
    v = F.col("value")
    submit = F.when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(v / 4)
    return rounded(rolling.breakdown(table(spark, sf_dir, "events"), ["event_id"], {"fetch": v, "evaluate": v * 3 - 20, "submit": submit}))


@query(f"""WITH {TASKS} SELECT id, state || '-' || sequence_nr AS name, 'clone_of:run-' || run_id || ':' || state || ':snapshot:' || id AS clone FROM tk""")
def task_names(spark, sf_dir):
    t = tasks(spark, sf_dir)
    clone = clone_name(F.concat(F.lit("run-"), F.col("run_id").cast("string")), F.col("state"), F.col("id"))
    return t.select("id", default_name(F.col("state"), F.col("sequence_nr")).alias("name"), clone.alias("clone"))


@query("""SELECT event_id, ceil(CAST(json_extract(props, '$.k') AS DOUBLE) / 10)::INT AS evaluators,
  greatest(0, least(1024 - event_id % 1100, 16, greatest(0, ceil(ceil(CAST(json_extract(props, '$.k') AS DOUBLE) / 10) * 1.5)::BIGINT - user_id % 9)))::BIGINT AS batches FROM events""")
def batch_plan(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.ceil(k / 10).cast("int").alias("evaluators"))
    n = control.batches_to_produce_column(control.QueueLimits(queue_buffer=1.5), F.col("user_id") % 9, F.col("event_id") % 1100, F.col("evaluators"))
    return e.select("event_id", "evaluators", n.alias("batches"))


@query("""WITH p AS (SELECT event_id, (event_id % 17)::BIGINT AS batches, (16 + event_id % 500)::BIGINT AS size, (event_id * 37 % 9000)::BIGINT AS most FROM events),
n AS (SELECT *, CASE WHEN batches <= 0 OR most = 0 THEN 0 WHEN most >= batches * size THEN batches ELSE least(batches, (most + size - 1) // size) END AS n FROM p)
SELECT event_id, n AS planned, CASE WHEN n = 0 THEN 0 WHEN most >= batches * size THEN size ELSE most // n + most % n END AS first_size,
  CASE WHEN n < 2 THEN 0 WHEN most >= batches * size THEN size ELSE most // n END AS other_size FROM n""")
def batch_split(spark, sf_dir):
    """Sizes of the batches that a tick inserts when what may still be produced is limited."""
    i = F.col("event_id")
    sizes = control.split_samples_column(i % 17, 16 + i % 500, i * 37 % 9000)
    size = lambda at: F.coalesce(F.get("sizes", at), F.lit(0)).cast("bigint")
    rows = table(spark, sf_dir, "events").select("event_id", sizes.alias("sizes"))
    return rows.select("event_id", F.size("sizes").cast("bigint").alias("planned"), size(0).alias("first_size"), size(1).alias("other_size"))


@query("""WITH p AS (SELECT event_id, (16 + event_id % 4081)::DOUBLE AS size, value / 100 AS ms FROM events WHERE value > 0)
SELECT event_id, least(greatest(round(size * least(greatest(1500 / (ms * size), 0.25), 4.0)), 16), 65536)::BIGINT AS next_size FROM p""")
def batch_size_controller(spark, sf_dir):
    size, ms = (16 + F.col("event_id") % 4081).cast("double"), F.col("value") / 100
    return table(spark, sf_dir, "events").where("value > 0").select("event_id", control.next_batch_size_column(size, ms, 1500, 65536).alias("next_size"))


@query("SELECT event_id, least(greatest(round((16 + event_id % 70000) * 0.25), 16), 16384)::BIGINT AS first_size FROM events")
def batch_size_carried(spark, sf_dir):
    """The first batch size of the task that follows one of the given size."""
    return table(spark, sf_dir, "events").select("event_id", control.carried_batch_size_column(16 + F.col("event_id") % 70000, 16384).alias("first_size"))

