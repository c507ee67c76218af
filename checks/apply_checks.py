"""Stores, task bodies, message codecs, arithmetic."""

from pyspark.sql import functions as F

from checks.registry import as_of_events, check, us
from opslens.operators import apply as ops, memory, snapshot
from opslens.sources import tables

ACCESS_SQL = """stores AS (SELECT memory_id, key, max(seq) AS last_seq, min(seq) AS first_seq FROM memory_op WHERE op = 'store' GROUP BY 1, 2),
reads AS (SELECT m.memory_id, m.key, count(*) FILTER (WHERE m.seq > s.last_seq) AS hits, count(*) FILTER (WHERE s.first_seq IS NULL OR m.seq < s.first_seq) AS misses
  FROM memory_op m LEFT JOIN stores s ON m.memory_id = s.memory_id AND m.key = s.key WHERE m.op = 'retrieve' GROUP BY 1, 2),
access AS (SELECT coalesce(s.memory_id, r.memory_id) AS memory_id, coalesce(s.key, r.key) AS key, s.key IS NOT NULL AS stored, coalesce(r.hits, 0) AS hits, coalesce(r.misses, 0) AS misses
  FROM stores s FULL JOIN reads r ON s.memory_id = r.memory_id AND s.key = r.key)"""


@check("memory_access_counts", "memory_op", f"WITH {ACCESS_SQL} SELECT * FROM access")
def _(spark, d):
    return memory.memory_access_counts(tables.memory_op(spark, d))


@check(
    "eviction_candidates",
    "memory_op",
    f"""WITH {ACCESS_SQL} SELECT memory_id, key, hits, CAST(rn AS INT) AS rank FROM (SELECT a.*, row_number() OVER (PARTITION BY a.memory_id ORDER BY hits, s.last_seq) AS rn
    FROM access a JOIN stores s ON a.memory_id = s.memory_id AND a.key = s.key) WHERE rn <= 2""",
)
def _(spark, d):
    return memory.eviction_candidates(tables.memory_op(spark, d), 2).select("memory_id", "key", "hits", "rank")


@check(
    "apply_by_type",
    "task",
    """SELECT task_id, task_type <> 'gpu' AND NOT (task_type = 'io' AND max_latency_ms = 0) AS success,
      CASE task_type WHEN 'compute' THEN amount * 2 WHEN 'io' THEN CASE WHEN max_latency_ms <> 0 THEN amount / max_latency_ms END WHEN 'memory' THEN floor(amount) END AS result,
      CASE WHEN task_type = 'gpu' THEN 'No worker pool for task type: gpu' WHEN task_type = 'io' AND max_latency_ms = 0 THEN 'no result' END AS error FROM task""",
)
def _(spark, d):
    registry = {"compute": F.col("amount") * 2, "io": F.try_divide(F.col("amount"), F.col("max_latency_ms"))}
    return ops.apply_by_type(tables.task(spark, d), registry, {"memory": lambda part: part["amount"] // 1})


@check(
    "apply_with_retry",
    "task",
    """WITH n AS (SELECT unnest([1, 2, 3, 4]) AS attempt), a AS (SELECT task_id, priority5, attempt, (task_id + attempt) % 3 = 0 AS success FROM task, n),
    f AS (SELECT *, coalesce(min(CASE WHEN success THEN attempt END) OVER (PARTITION BY task_id), 4) AS last FROM a)
    SELECT task_id, attempt, CAST(least(priority5 + attempt - 1, 4) AS INT) AS priority5, success, CASE WHEN success THEN CAST(task_id * attempt AS DOUBLE) END AS result,
      CASE WHEN success THEN 'completed' WHEN attempt = 4 THEN 'failed' ELSE 'retried' END AS outcome, CASE WHEN NOT success THEN 'attempt ' || CAST(attempt AS VARCHAR) || ' failed' END AS error
    FROM f WHERE attempt <= last""",
)
def _(spark, d):
    return ops.apply_with_retry(
        tables.task(spark, d),
        lambda n: F.col("task_id") * n,
        lambda n: F.when((F.col("task_id") + n) % 3 != 0, F.concat(F.lit("attempt "), n.cast("string"), F.lit(" failed"))),
    )


@check(
    "eval_arithmetic",
    "",
    """SELECT event_id, operation, CASE operation WHEN 'add' THEN value + d WHEN 'subtract' THEN value - d WHEN 'multiply' THEN value * d WHEN 'divide' THEN CASE WHEN d <> 0 THEN value / d END END AS result,
    CASE WHEN operation = 'power' THEN 'Unknown operation: power' END AS error
    FROM (SELECT event_id, value, CAST(event_id % 5 AS DOUBLE) AS d, (['add', 'subtract', 'multiply', 'divide', 'power'])[CAST(event_id % 7 % 5 + 1 AS INT)] AS operation FROM events)""",
)
def _(spark, d):
    m = tables.metric(spark, d)
    names = F.array(*[F.lit(x) for x in ("add", "subtract", "multiply", "divide", "power")])
    payloads = m.select(
        F.col("seq").alias("event_id"), F.col("value").alias("a"), (F.col("seq") % 5).alias("b"), F.element_at(names, (F.col("seq") % 7 % 5 + 1).cast("int")).alias("operation")
    )
    return ops.eval_arithmetic(payloads).select("event_id", "operation", "result", "error")


@check(
    "decode_json",
    "",
    "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN '{\"k\":' || json_extract_string(props, '$.k') || '}' END AS value, CASE WHEN event_id % 4 = 0 THEN 'Cannot decode JSON data' END AS error FROM events",
)
def _(spark, d):
    raw = tables.metric(spark, d).select(F.col("seq").alias("event_id"), F.when(F.col("seq") % 4 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props")).alias("data"))
    return ops.decode_messages(raw, "json").select("event_id", "value", "error")


@check(
    "decode_base64",
    "",
    "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN text END AS value, CASE WHEN doc_id % 5 = 0 THEN 'Cannot decode Base64 data' END AS error FROM documents",
)
def _(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("data"))
    sent = ops.encode_messages(docs, "base64").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat("encoded", F.lit("*"))).otherwise(F.col("encoded")).alias("data"))
    return ops.decode_messages(sent, "base64").select("doc_id", "value", "error")


@check(
    "decode_framed",
    "",
    "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text END AS value, CASE WHEN turn % 2 <> 0 THEN 'Invalid message format' END AS error FROM conversations",
)
def _(spark, d):
    talks = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("data"))
    sent = ops.encode_messages(talks, "framed").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("encoded")).otherwise(F.col("data")).alias("data"))
    return ops.decode_messages(sent, "framed").select("conv_id", "turn", "value", "error")


@check(
    "metrics_snapshot",
    "metric health_class alert_event",
    """SELECT user_id AS member, 'metrics' AS section, name AS what, CAST(count(*) AS VARCHAR) AS shown FROM metric GROUP BY 1, 3
    UNION ALL SELECT host, 'health', "check", arg_max(status, (ts_us, seq)) FROM health_class GROUP BY 1, 3
    UNION ALL SELECT e.user_id, 'alerts', CAST(x.alert_id AS VARCHAR), x.level FROM alert_event x JOIN events e ON e.event_id = x.alert_id WHERE x.op = 'create' AND x.alert_id % 3 <> 0""",
)
def _(spark, d):
    def item(path):
        return F.get_json_object("item", path)

    return snapshot.fleet_snapshot(spark, d, as_of_events()).select(
        "member",
        "section",
        F.coalesce(item("$.name"), item("$.check"), item("$.alert_id")).alias("what"),
        F.coalesce(item("$.count"), item("$.status"), item("$.level")).alias("shown"),
    )


TABLE_SQL = " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows FROM {t}" for t in ("task", "task_event", "queue_event", "result", "metric", "gauge_op", "health", "alert_event", "pool", "pool_tick", "memory_op"))


@check("load_tables", "task task_event queue_event result metric gauge_op health alert_event pool pool_tick memory_op", TABLE_SQL)
def _(spark, d):
    views = tables.load_tables(spark, d)
    out = None
    for name in ("task", "task_event", "queue_event", "result", "metric", "gauge_op", "health", "alert_event", "pool", "pool_tick", "memory_op"):
        part = views[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
