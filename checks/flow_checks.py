"""Counts, depths, utilisation and folds over event logs."""

from pyspark.sql import functions as F

from checks.registry import as_of_tasks, check, r, us
from opslens.operators import flow, tasks as task_ops
from opslens.sources import tables

CHAIN_SQL = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts_us, seq) AS attempt FROM result),
walked AS (SELECT *, coalesce(bool_or(success) OVER (PARTITION BY task_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM numbered),
chain AS (SELECT *, CASE WHEN success THEN 'completed' WHEN attempt = 4 THEN 'failed' ELSE 'retried' END AS outcome FROM walked WHERE attempt <= 4 AND NOT over)
"""


@check(
    "scheduling_summary",
    "task_event",
    """WITH c AS (SELECT priority7, count(*) FILTER (WHERE event = 'pending') AS submitted, count(*) FILTER (WHERE event = 'completed') AS completed,
      count(*) FILTER (WHERE event = 'failed') AS failed, count(*) FILTER (WHERE event = 'cancelled') AS cancelled,
      count(*) FILTER (WHERE event = 'deadline_missed') AS deadline_missed, CAST(0 AS BIGINT) AS inversions, CAST(0 AS BIGINT) AS preemptions
    FROM task_event GROUP BY ROLLUP (priority7))
    SELECT *, completed / (({as_of_tasks} - 788918400000000) / 1000000.0::DOUBLE) AS throughput_per_second,
      round(completed * 100.0::DOUBLE / submitted + 1e-9, 6) AS success_pct FROM c""",
)
def _(spark, d):
    since = F.lit("1995-01-01 00:00:00").cast("timestamp")
    out = flow.scheduling_summary(tables.task_event(spark, d), since, as_of_tasks())
    return out.withColumn("success_pct", r("success_pct"))


@check(
    "queue_stats",
    "queue_event",
    """WITH p AS (SELECT queue_id, priority5, sum(CASE event WHEN 'put' THEN 1 ELSE -1 END) AS size, count(*) FILTER (WHERE event = 'put') AS enqueued,
      count(*) FILTER (WHERE event = 'get') AS dequeued, count(*) FILTER (WHERE event = 'expire') AS expired FROM queue_event GROUP BY 1, 2)
    SELECT queue_id, CAST(sum(size) AS BIGINT) AS size, CAST(sum(enqueued) AS BIGINT) AS enqueued, CAST(sum(dequeued) AS BIGINT) AS dequeued,
      CAST(0 AS BIGINT) AS rejected, CAST(sum(expired) AS BIGINT) AS expired,
      coalesce(string_agg(CASE WHEN size > 0 THEN priority5 || ':' || CAST(size AS BIGINT) END, ',' ORDER BY priority5), '') AS distribution
    FROM p GROUP BY 1""",
)
def _(spark, d):
    out = flow.queue_stats(tables.queue_event(spark, d))
    pairs = F.transform(F.map_entries("distribution"), lambda e: F.concat_ws(":", e.key.cast("string"), e.value.cast("string")))
    return out.withColumn("distribution", F.array_join(pairs, ","))


@check(
    "coordinator_stats",
    "result",
    f"""WITH {CHAIN_SQL} SELECT count(*) FILTER (WHERE attempt = 1) AS submitted, count(*) FILTER (WHERE outcome = 'completed') AS completed,
    count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'retried') AS retried,
    sum(processing_ms) FILTER (WHERE outcome = 'completed') AS total_processing_ms, count(*) FILTER (WHERE outcome <> 'retried') AS results_held FROM chain""",
)
def _(spark, d):
    return flow.coordinator_stats(task_ops.retry_chain(tables.result(spark, d), tables.task(spark, d)))


WORKER_SQL = """
SELECT pool, worker_id, count(*) FILTER (WHERE success) AS completed, count(*) FILTER (WHERE NOT success) AS failed,
  coalesce(sum(processing_ms) FILTER (WHERE success), 0) AS total_processing_ms,
  round(coalesce(avg(processing_ms) FILTER (WHERE success), 0) + 1e-9, 6) AS mean_processing_ms,
  min(ts_us) AS first_task_us, max(ts_us) FILTER (WHERE success) AS last_task_us,
  arg_max(CASE WHEN success THEN 'completed' ELSE 'failed' END, (ts_us, seq)) AS last_outcome
FROM result GROUP BY 1, 2
"""


@check("worker_stats", "result", WORKER_SQL)
def _(spark, d):
    out = flow.worker_stats(tables.result(spark, d))
    return out.select(
        "pool", "worker_id", "completed", "failed", "total_processing_ms", r("mean_processing_ms"), us("first_task_at"), us("last_task_at"), "last_outcome"
    )


@check(
    "pool_stats",
    "result",
    f"""WITH w AS ({WORKER_SQL}) SELECT pool, worker_id, CAST(sum(completed) AS BIGINT) AS completed, CAST(sum(failed) AS BIGINT) AS failed,
    sum(total_processing_ms) AS total_processing_ms, count(*) AS workers, count(*) FILTER (WHERE last_outcome = 'completed') AS workers_well,
    round(coalesce(sum(total_processing_ms) / sum(completed), 0) + 1e-9, 6) AS mean_processing_ms FROM w GROUP BY ROLLUP (pool, worker_id)""",
)
def _(spark, d):
    return flow.pool_stats(tables.result(spark, d)).withColumn("mean_processing_ms", r("mean_processing_ms"))


@check(
    "resource_wait_stats",
    "wait",
    "SELECT resource, count(*) AS waiters, round(avg((1009843200000000 - ts_us) / 1000.0::DOUBLE) + 1e-9, 3) AS mean_wait_ms, max((1009843200000000 - ts_us) / 1000.0::DOUBLE) AS max_wait_ms FROM wait GROUP BY 1",
)
def _(spark, d):
    waits = tables.resource_wait(tables.resource_claim(spark, d))
    as_of = F.lit("2002-01-01 00:00:00").cast("timestamp")
    return flow.resource_wait_stats(waits, as_of).withColumn("mean_wait_ms", r("mean_wait_ms", 3))


@check(
    "level_sizes",
    "task",
    """WITH lv AS (SELECT queue_id, CASE priority7 WHEN 100 THEN 0 WHEN 90 THEN 0 WHEN 80 THEN 1 WHEN 50 THEN 2 ELSE 3 END AS level FROM task)
    SELECT q.queue_id, CAST(n.level AS INT) AS level, count(lv.level) AS size FROM (SELECT DISTINCT queue_id FROM lv) q
    CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS level) n LEFT JOIN lv ON lv.queue_id = q.queue_id AND lv.level = n.level GROUP BY 1, 2""",
)
def _(spark, d):
    leveled = tables.task(spark, d).withColumn("level", task_ops.initial_level())
    return flow.level_sizes(leveled, ["queue_id"])


@check(
    "queue_depth",
    "queue_event",
    """SELECT queue_id, seq, event, CAST(sum(CASE event WHEN 'put' THEN 1 ELSE -1 END) OVER (PARTITION BY queue_id ORDER BY ts_us, seq
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM queue_event""",
)
def _(spark, d):
    return flow.queue_depth(tables.queue_event(spark, d)).select("queue_id", "seq", "event", "depth")


@check(
    "queue_depth_null_keys",
    "queue_event",
    """WITH q AS (SELECT CASE WHEN task_id % 11 <> 0 THEN queue_id END AS queue_id, CASE WHEN task_id % 13 <> 0 THEN ts_us END AS ts_us, seq, event FROM queue_event)
    SELECT queue_id, seq, event, CAST(sum(CASE event WHEN 'put' THEN 1 ELSE -1 END) OVER (PARTITION BY queue_id ORDER BY ts_us NULLS FIRST, seq
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM q""",
)
def _(spark, d):
    log = tables.queue_event(spark, d).withColumns(
        {"queue_id": F.when(F.col("task_id") % 11 != 0, F.col("queue_id")), "ts": F.when(F.col("task_id") % 13 != 0, F.col("ts"))}
    )
    return flow.queue_depth(log).select("queue_id", "seq", "event", "depth")


@check(
    "active_over_time",
    "result",
    """WITH mark AS (SELECT ts_us AS at_us, 1 AS step FROM result UNION ALL SELECT ts_us + CAST(processing_ms * 1000 AS BIGINT), -1 FROM result),
    step AS (SELECT at_us, sum(step) AS step FROM mark GROUP BY 1)
    SELECT at_us, CAST(sum(step) OVER (ORDER BY at_us) AS BIGINT) AS active, round(sum(step) OVER (ORDER BY at_us) * 100.0::DOUBLE / 100 + 1e-9, 6) AS utilization_pct FROM step""",
)
def _(spark, d):
    out = flow.active_over_time(tables.result(spark, d), total_workers=100)
    return out.select(us("at"), "active", r("utilization_pct"))


for _rule, _case in (
    (
        "coordinator",
        "CASE WHEN queue_size > 5 * active_workers AND active_workers < max_workers THEN 1 WHEN queue_size = 0 AND active_workers > min_workers THEN -1 ELSE 0 END",
    ),
    (
        "adaptive",
        "CASE WHEN active_workers = 0 THEN 0 WHEN queue_size / active_workers > 0.8 THEN 1 WHEN queue_size / active_workers < 0.2 THEN -1 ELSE 0 END",
    ),
):

    @check(
        f"scaling_decision_{_rule}",
        "pool_tick",
        f"""SELECT task_type, ts_us, change, greatest(min_workers, least(max_workers, active_workers + change)) AS target FROM
        (SELECT *, {_case} AS change FROM (SELECT *, CAST(2 AS BIGINT) AS min_workers, CAST(6 AS BIGINT) AS max_workers FROM pool_tick))""",
    )
    def _(spark, d, rule=_rule):
        ticks = tables.pool_tick(spark, d).withColumns({"min_workers": F.lit(2).cast("bigint"), "max_workers": F.lit(6).cast("bigint")})
        return flow.scaling_decision(ticks, rule=rule).select("task_type", us("ts"), "change", "target")


@check(
    "oldest_workers",
    "result",
    """WITH w AS (SELECT pool, worker_id, min(ts_us) AS started_us FROM result GROUP BY 1, 2)
    SELECT pool, worker_id, started_us FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY started_us, worker_id) AS rn FROM w) WHERE rn <= 2""",
)
def _(spark, d):
    workers = tables.result(spark, d).groupBy("pool", "worker_id").agg(F.min("ts").alias("started_at"))
    return task_ops.next_k(workers, ["pool"], ["started_at", "worker_id"], 2).select("pool", "worker_id", us("started_at"))


@check(
    "dedupe_enqueue",
    "result",
    "SELECT task_id, worker_id, ts_us, seq FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts_us, seq) AS rn FROM result) WHERE rn = 1",
)
def _(spark, d):
    return flow.dedupe_enqueue(tables.result(spark, d)).select("task_id", "worker_id", us("ts"), "seq")


@check(
    "still_queued",
    "queue_event",
    """WITH log AS (SELECT queue_id, task_id, ts_us, seq, event FROM queue_event UNION ALL
      SELECT queue_id, task_id, ts_us + 86400000000, seq + 2, 'put' FROM queue_event WHERE event = 'get' AND task_id % 7 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY queue_id, task_id ORDER BY ts_us DESC, seq DESC) AS rn FROM log),
    cleared AS (SELECT queue_id, max(seq) AS clear_seq FROM queue_event WHERE event = 'expire' AND queue_id % 10 = 0 GROUP BY 1)
    SELECT q.queue_id, q.task_id, q.seq FROM ranked q LEFT JOIN cleared c ON q.queue_id = c.queue_id
    WHERE q.rn = 1 AND q.event = 'put' AND (c.clear_seq IS NULL OR q.seq > c.clear_seq)""",
)
def _(spark, d):
    log = tables.queue_event(spark, d)
    cleared = log.where((F.col("event") == "expire") & (F.col("queue_id") % 10 == 0)).select("queue_id", F.col("seq").alias("clear_seq"))
    # a seventh of the tasks come back a day after they were taken
    again = log.where((F.col("event") == "get") & (F.col("task_id") % 7 == 0)).withColumns(
        {"ts": F.col("ts") + F.expr("INTERVAL 1 DAY"), "seq": F.col("seq") + 2, "event": F.lit("put")}
    )
    out = flow.still_queued(log.unionByName(again), cleared)
    return out.select("queue_id", "task_id", "seq")


@check(
    "union_sources",
    "task result",
    """SELECT 'task' AS source_name, task_id, pool, status, CAST(NULL AS BIGINT) AS worker_id FROM task
    UNION ALL SELECT 'result', task_id, pool, NULL, worker_id FROM result""",
)
def _(spark, d):
    return flow.union_sources(
        {
            "task": tables.task(spark, d).select("task_id", "pool", "status"),
            "result": tables.result(spark, d).select("task_id", "pool", "worker_id"),
        }
    )


@check(
    "admit",
    "queue_event",
    """WITH numbered AS (SELECT queue_id, seq, event, row_number() OVER (PARTITION BY queue_id ORDER BY ts_us, seq) AS rn FROM queue_event),
    walk AS (
      SELECT queue_id, rn, seq, event, event = 'put' AS accepted, CAST(CASE event WHEN 'put' THEN 1 ELSE 0 END AS BIGINT) AS depth FROM numbered WHERE rn = 1
      UNION ALL
      SELECT n.queue_id, n.rn, n.seq, n.event, CASE n.event WHEN 'put' THEN w.depth < 3 ELSE w.depth > 0 END,
        CASE n.event WHEN 'put' THEN least(w.depth + 1, 3) ELSE greatest(w.depth - 1, 0) END
      FROM walk w JOIN numbered n ON n.queue_id = w.queue_id AND n.rn = w.rn + 1)
    SELECT queue_id, seq, event, accepted, depth FROM walk""",
    recursive=True,
)
def _(spark, d):
    return flow.admit(tables.queue_event(spark, d), 3).select("queue_id", "seq", "event", "accepted", "depth")


@check(
    "apply_level_moves",
    "task result",
    """WITH moves AS (SELECT task_id, list(CASE WHEN success THEN -1 ELSE 1 END ORDER BY ts_us, seq) AS steps FROM result GROUP BY 1),
    start AS (SELECT task_id, CAST(CASE priority7 WHEN 100 THEN 0 WHEN 90 THEN 0 WHEN 80 THEN 1 WHEN 50 THEN 2 ELSE 3 END AS BIGINT) AS level FROM task)
    SELECT task_id, level, CASE WHEN steps IS NULL THEN level ELSE CAST(list_reduce(steps, lambda a, x: greatest(0, least(3, a + x)), CAST(level AS INT)) AS BIGINT) END AS final_level
    FROM start LEFT JOIN moves USING (task_id)""",
)
def _(spark, d):
    start = tables.task(spark, d).withColumn("level", task_ops.initial_level())
    moves = tables.result(spark, d).withColumn("move", F.when(F.col("success"), -1).otherwise(1).cast("bigint"))
    return flow.apply_level_moves(start, moves)
