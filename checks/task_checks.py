"""Task predicates, orders, joins and attempts."""

from pyspark.sql import functions as F

from checks.registry import as_of_tasks, check, us
from opslens.functions import fixed
from opslens.operators import tasks as ops
from opslens.sources import tables


@check(
    "validate_constraints",
    "task",
    """SELECT task_id, array_to_string(list_filter([
      CASE WHEN min_start_us >= deadline_us THEN 'min_start_time must be before deadline' END,
      CASE WHEN max_latency_ms <> 0 AND max_latency_ms > max_duration_ms THEN 'max_latency_ms exceeds max_duration' END,
      CASE WHEN is_hard_realtime AND deadline_us IS NULL THEN 'hard realtime tasks must have a deadline' END], lambda x: x IS NOT NULL), ';') AS errors
    FROM task""",
)
def _(spark, d):
    out = ops.validate_constraints(tables.task(spark, d))
    return out.select("task_id", F.array_join("errors", ";").alias("errors"))


@check(
    "task_predicates",
    "task",
    """SELECT task_id, status = 'pending' AND min_start_us <= {as_of_tasks} AS is_ready,
      coalesce(deadline_us - {as_of_tasks} <= 86400000000, false) AS deadline_approaching,
      coalesce(deadline_us < {as_of_tasks}, false) AS missed_deadline,
      status IN ('pending', 'ready', 'blocked') AS cancel_by_task, status IN ('pending', 'ready') AS cancel_by_scheduler
    FROM task""",
)
def _(spark, d):
    now = as_of_tasks()
    return tables.task(spark, d).select(
        "task_id",
        ops.is_ready(now).alias("is_ready"),
        ops.deadline_approaching(86_400_000, now).alias("deadline_approaching"),
        ops.missed_deadline(now).alias("missed_deadline"),
        ops.cancel_eligible("task").alias("cancel_by_task"),
        ops.cancel_eligible("scheduler").alias("cancel_by_scheduler"),
    )


@check(
    "deadline_violations",
    "task",
    """SELECT task_id, status, deadline_us, is_hard_realtime AS is_hard_violation FROM task
    WHERE status <> 'completed' AND deadline_us < {as_of_tasks}""",
)
def _(spark, d):
    return ops.deadline_violations(tables.task(spark, d), as_of_tasks()).select("task_id", "status", us("deadline"), "is_hard_violation")


@check("urgent_tasks", "task", "SELECT task_id, deadline_us FROM task WHERE status = 'pending' AND deadline_us - {as_of_tasks} <= 100000")
def _(spark, d):
    return ops.urgent_tasks(tables.task(spark, d), as_of_tasks()).select("task_id", us("deadline"))


@check(
    "earliest_urgent",
    "task",
    """SELECT pool, task_id, deadline_us FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY deadline_us, seq) AS rn FROM task
    WHERE status = 'pending' AND deadline_us - {as_of_tasks} <= 100000) WHERE rn = 1""",
)
def _(spark, d):
    return ops.earliest_urgent(tables.task(spark, d), ["pool"], as_of_tasks()).select("pool", "task_id", us("deadline"))


@check("expired_tasks", "task", "SELECT task_id, queue_id, deadline_us FROM task WHERE status = 'pending' AND deadline_us < {as_of_tasks}")
def _(spark, d):
    queued = tables.task(spark, d).where(F.col("status") == "pending")
    return ops.split_expired(queued, as_of_tasks())[1].select("task_id", "queue_id", us("deadline"))


@check(
    "live_tasks",
    "task",
    "SELECT task_id, queue_id FROM task WHERE status = 'pending' AND NOT coalesce(deadline_us < {as_of_tasks}, false)",
)
def _(spark, d):
    queued = tables.task(spark, d).where(F.col("status") == "pending")
    return ops.split_expired(queued, as_of_tasks())[0].select("task_id", "queue_id")


@check("tasks_by_type", "task", "SELECT task_id, task_type FROM task WHERE task_type = 'io'")
def _(spark, d):
    return ops.tasks_by_type(tables.task(spark, d), "io").select("task_id", "task_type")


@check("initial_level", "task", "SELECT task_id, level, CAST(10 * pow(2, level) AS INT) AS slice_ms FROM (SELECT task_id, CASE priority7 WHEN 100 THEN 0 WHEN 90 THEN 0 WHEN 80 THEN 1 WHEN 50 THEN 2 ELSE 2 END AS level FROM task)")
def _(spark, d):
    out = tables.task(spark, d).withColumn("level", ops.initial_level(3))
    return out.select("task_id", "level", ops.time_slice_ms(F.col("level")).alias("slice_ms"))


@check(
    "route_latency_metric",
    "task",
    """SELECT task_id, CASE WHEN name LIKE 'perception%' THEN 'perception_latency_ms' WHEN name LIKE 'reasoning%' THEN 'reasoning_latency_ms' END AS metric,
    CASE WHEN name LIKE 'perception%' THEN 'execution' END AS type_label, CASE WHEN name LIKE 'reasoning%' THEN '1' END AS system_label FROM task""",
)
def _(spark, d):
    route = ops.route_latency_metric()
    return tables.task(spark, d).select(
        "task_id",
        route["metric"].alias("metric"),
        F.try_element_at(route["labels"], F.lit("type")).alias("type_label"),
        F.try_element_at(route["labels"], F.lit("system")).alias("system_label"),
    )


@check(
    "split_valid",
    "task",
    """SELECT task_id, false AS success, 'Task validation failed' AS error FROM task WHERE NOT (amount > 100000 AND task_type <> 'gpu')""",
)
def _(spark, d):
    rule = (F.col("amount") > 100000) & (F.col("task_type") != "gpu")
    return ops.split_valid(tables.task(spark, d), rule)[1]


@check(
    "priority_names",
    "task",
    """SELECT task_id, CASE priority7 WHEN 100 THEN 'REALTIME' WHEN 90 THEN 'CRITICAL' WHEN 80 THEN 'HIGH' WHEN 50 THEN 'NORMAL' ELSE 'LOW' END AS name7,
    CASE priority5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'NORMAL' WHEN 3 THEN 'LOW' ELSE 'BACKGROUND' END AS name5,
    priority7 AS value7, priority5 AS value5 FROM task""",
)
def _(spark, d):
    t = tables.task(spark, d)
    named = t.select("task_id", fixed.priority7_name("priority7").alias("name7"), fixed.priority5_name("priority5").alias("name5"))
    return named.withColumns({"value7": fixed.priority7_value("name7"), "value5": fixed.priority5_value("name5")})


@check("priority_order", "task", "SELECT queue_id, task_id, row_number() OVER (PARTITION BY queue_id ORDER BY priority7 DESC, seq) AS rank FROM task WHERE status = 'pending'")
def _(spark, d):
    queued = tables.task(spark, d).where(F.col("status") == "pending")
    return ops.priority_order(queued, ["queue_id"]).select("queue_id", "task_id", "rank")


@check(
    "edf_order",
    "task",
    """SELECT pool, task_id, row_number() OVER (PARTITION BY pool ORDER BY deadline_us ASC NULLS LAST, seq) AS rank,
    coalesce(deadline_us < {as_of_tasks}, false) AS deadline_missed FROM task WHERE status = 'pending'""",
)
def _(spark, d):
    queued = tables.task(spark, d).where(F.col("status") == "pending")
    return ops.edf_order(queued, ["pool"], as_of_tasks()).select("pool", "task_id", "rank", "deadline_missed")


@check(
    "edf_order_null_time",
    "task",
    """WITH t AS (SELECT CASE WHEN task_id % 9 <> 0 THEN pool END AS pool, task_id, seq, CASE WHEN task_id % 4 <> 0 THEN deadline_us END AS deadline_us FROM task WHERE status = 'pending')
    SELECT pool, task_id, row_number() OVER (PARTITION BY pool ORDER BY deadline_us ASC NULLS LAST, seq) AS rank,
    coalesce(deadline_us < {as_of_tasks}, false) AS deadline_missed FROM t""",
)
def _(spark, d):
    queued = tables.task(spark, d).where(F.col("status") == "pending").withColumns(
        {"pool": F.when(F.col("task_id") % 9 != 0, F.col("pool")), "deadline": F.when(F.col("task_id") % 4 != 0, F.col("deadline"))}
    )
    return ops.edf_order(queued, ["pool"], as_of_tasks()).select("pool", "task_id", "rank", "deadline_missed")


@check(
    "task_order",
    "task",
    """SELECT pool, task_id, row_number() OVER (PARTITION BY pool ORDER BY priority7 DESC, deadline_us ASC NULLS LAST,
    CASE WHEN deadline_us IS NULL THEN created_us END, seq) AS rank FROM task""",
)
def _(spark, d):
    return ops.task_order(tables.task(spark, d), ["pool"]).select("pool", "task_id", "rank")


@check("dispatch_order", "task", "SELECT task_type, task_id, row_number() OVER (PARTITION BY task_type ORDER BY priority5, created_us, seq) AS rank FROM task")
def _(spark, d):
    return ops.dispatch_order(tables.task(spark, d), ["task_type"]).select("task_type", "task_id", "rank")


@check(
    "fair_order",
    "task",
    """SELECT queue_id, task_id, level, row_number() OVER (PARTITION BY queue_id ORDER BY level, seq) AS rank, CAST(10 * pow(2, level) AS INT) AS slice_ms
    FROM (SELECT *, CASE priority7 WHEN 100 THEN 0 WHEN 90 THEN 0 WHEN 80 THEN 1 WHEN 50 THEN 2 ELSE 3 END AS level FROM task WHERE status = 'pending')""",
)
def _(spark, d):
    queued = tables.task(spark, d).where(F.col("status") == "pending")
    return ops.fair_order(queued, ["queue_id"]).select("queue_id", "task_id", "level", "rank", "slice_ms")


@check(
    "next_k_per_queue",
    "task",
    "SELECT * FROM (SELECT queue_id, task_id, CAST(row_number() OVER (PARTITION BY queue_id ORDER BY priority7 DESC, seq) AS INT) AS rank FROM task WHERE status = 'pending') WHERE rank <= 3",
)
def _(spark, d):
    queued = tables.task(spark, d).where(F.col("status") == "pending")
    return ops.next_k(queued, ["queue_id"], [F.col("priority7").desc(), F.col("seq")], 3).select("queue_id", "task_id", "rank")


@check("next_k", "task", "SELECT task_id, priority7, deadline_us FROM task WHERE status = 'pending' ORDER BY deadline_us ASC NULLS LAST, seq LIMIT 100")
def _(spark, d):
    queued = tables.task(spark, d).where(F.col("status") == "pending")
    return ops.next_k(queued, [], [F.col("deadline").asc_nulls_last(), F.col("seq")], 100).select("task_id", "priority7", us("deadline"))


@check("all_in_order", "task", "SELECT task_id, queue_id, priority7 FROM task WHERE status = 'pending' ORDER BY priority7 DESC, seq")
def _(spark, d):
    queued = tables.task(spark, d).where(F.col("status") == "pending")
    return ops.all_in_order(queued, [F.col("priority7").desc(), F.col("seq")]).select("task_id", "queue_id", "priority7")


@check(
    "latest_priority",
    "result",
    "SELECT task_id, CAST(arg_max(seq % 5, ts_us::HUGEINT * 1000000000000000000 + seq) AS INT) AS priority5 FROM result GROUP BY 1",
)
def _(spark, d):
    writes = tables.result(spark, d).select("task_id", (F.col("seq") % 5).cast("int").alias("priority5"), F.struct("ts", "seq").alias("seq"))
    return ops.latest_priority(writes)


@check(
    "dependencies_satisfied",
    "task",
    """WITH dep AS (SELECT task_id, unnest(depends_on) AS dep FROM task),
    unmet AS (SELECT d.task_id, count(*) AS unmet FROM dep d LEFT JOIN task t ON t.task_id = d.dep AND t.status = 'completed' WHERE t.task_id IS NULL GROUP BY 1)
    SELECT task_id, coalesce(unmet, 0) AS unmet, CASE WHEN coalesce(unmet, 0) > 0 THEN 'blocked' ELSE 'ready' END AS dependency_state
    FROM task LEFT JOIN unmet USING (task_id)""",
)
def _(spark, d):
    return ops.dependencies_satisfied(tables.task(spark, d)).select("task_id", "unmet", "dependency_state")


@check(
    "preemption_candidates",
    "task",
    """WITH victim AS (SELECT * FROM (SELECT pool, task_id AS victim_id, priority7 AS victim_priority, deadline_us AS victim_deadline,
      row_number() OVER (PARTITION BY pool ORDER BY priority7, seq) AS rn FROM task WHERE status = 'running' AND is_preemptible) WHERE rn = 1)
    SELECT t.pool, t.task_id, t.priority7, v.victim_id, v.victim_priority FROM task t JOIN victim v ON t.pool = v.pool
    WHERE t.status = 'pending' AND t.priority7 >= 80 AND t.is_hard_realtime AND t.priority7 > v.victim_priority
    AND (t.priority7 = 100 OR coalesce(t.deadline_us - {as_of_tasks} < (v.victim_deadline - {as_of_tasks}) * 0.8::DOUBLE, true))""",
)
def _(spark, d):
    return ops.preemption_candidates(tables.task(spark, d), ["pool"], as_of_tasks())


@check("route_to_pool", "task pool", "SELECT task_id, task_type, min_workers, max_workers FROM task JOIN pool USING (task_type)")
def _(spark, d):
    out = ops.route_to_pool(tables.task(spark, d), tables.pool(spark, d))
    return out.select("task_id", "task_type", "min_workers", "max_workers")


@check("unroutable", "task pool", "SELECT task_id, 'No worker pool for task type: ' || task_type AS error FROM task WHERE task_type NOT IN (SELECT task_type FROM pool)")
def _(spark, d):
    return ops.unroutable(tables.task(spark, d), tables.pool(spark, d)).select("task_id", "error")


FINAL_SQL = "final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts_us DESC, seq DESC) AS rn FROM result) WHERE rn = 1)"


@check("task_results", "task result", f"WITH {FINAL_SQL} SELECT task_id, status, worker_id, success, error, processing_ms, ts_us AS result_us FROM task LEFT JOIN final USING (task_id)")
def _(spark, d):
    out = ops.task_results(tables.task(spark, d), tables.result(spark, d))
    return out.select("task_id", "status", "worker_id", "success", "error", "processing_ms", us("result_ts", "result_us"))


@check("pending_results", "task result", "SELECT task_id, status FROM task WHERE task_id NOT IN (SELECT task_id FROM result)")
def _(spark, d):
    return ops.pending_results(tables.task(spark, d), tables.result(spark, d)).select("task_id", "status")


@check(
    "batch_results",
    "task result",
    f"""WITH {FINAL_SQL}, member AS (SELECT batch_id, task_id, success, error, processing_ms FROM task LEFT JOIN final USING (task_id)),
    state AS (SELECT batch_id, count(*) AS n_tasks, count(success) AS n_results FROM member GROUP BY 1)
    SELECT m.*, n_tasks FROM member m JOIN state s ON m.batch_id = s.batch_id WHERE n_tasks = n_results""",
)
def _(spark, d):
    return ops.batch_results(tables.task(spark, d), tables.result(spark, d))


@check(
    "retry_chain",
    "task result",
    """WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts_us, seq) AS attempt FROM result),
    walked AS (SELECT *, coalesce(bool_or(success) OVER (PARTITION BY task_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM numbered)
    SELECT w.task_id, w.attempt, CAST(least(t.priority5 + w.attempt - 1, 4) AS INT) AS priority5, w.worker_id, w.processing_ms, w.success,
      CASE WHEN w.success THEN 'completed' WHEN w.attempt = 4 THEN 'failed' ELSE 'retried' END AS outcome, w.error
    FROM walked w JOIN task t ON w.task_id = t.task_id WHERE w.attempt <= 4 AND NOT w.over""",
)
def _(spark, d):
    return ops.retry_chain(tables.result(spark, d), tables.task(spark, d))


@check(
    "lifecycle_check",
    "task_event",
    """WITH moved AS (SELECT task_id, seq, lag(event) OVER (PARTITION BY task_id ORDER BY ts_us, seq) AS from_status, event AS to_status FROM task_event)
    SELECT task_id, seq, from_status, to_status FROM moved WHERE from_status IS NOT NULL AND (from_status, to_status) NOT IN
      (('pending','ready'), ('pending','blocked'), ('blocked','pending'), ('pending','cancelled'), ('pending','deadline_missed'), ('ready','running'), ('ready','blocked'), ('running','completed'), ('running','failed'))""",
)
def _(spark, d):
    moves = ops.transition_table(spark, fixed.LIFECYCLE)
    return ops.lifecycle_check(tables.task_event(spark, d), moves).select("task_id", "seq", "from_status", "to_status")
