"""Structured logs, operation timing, contexts, throttled checks."""

from pyspark.sql import functions as F

from checks.registry import check, r, us
from checks.stats_checks import SUMMARY_SQL
from opslens.operators import logs as ops
from opslens.operators.throttle import throttle
from opslens.sources import configs, logs as log_source, tables


def parsed(spark, d):
    return log_source.parse_structured_logs(tables.log_line(spark, d))


@check(
    "read_structured_logs",
    "",
    """SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'app.' || event_type AS logger, 'event ' || CAST(event_id AS VARCHAR) AS message,
      event_id % 300 AS line, user_id AS thread_id, epoch_us(ts) AS ts_us, CASE WHEN event_type = 'error' THEN 'ValueError' END AS exception_type,
      CASE WHEN event_type = 'error' THEN 2 END AS traceback_lines, json_extract_string(props, '$.k') AS shard,
      CASE WHEN event_type IN ('click', 'error') THEN 'op' || CAST(event_id % 7 AS VARCHAR) END AS operation,
      CASE WHEN event_type IN ('click', 'error') THEN CASE WHEN event_id % 2 = 0 THEN 4 ELSE 3 END ELSE 1 END AS extras FROM events""",
)
def _(spark, d):
    return parsed(spark, d).where(F.col("_corrupt_record").isNull()).select(
        "level",
        "logger",
        "message",
        "line",
        "thread_id",
        us("ts"),
        F.col("exception.type").alias("exception_type"),
        F.when(F.col("exception").isNotNull(), F.size("exception.traceback")).alias("traceback_lines"),
        F.try_element_at("extra", F.lit("shard")).alias("shard"),
        F.try_element_at("context", F.lit("operation")).alias("operation"),
        F.size("extra").alias("extras"),
    )


@check(
    "log_round_trip",
    "",
    """SELECT 'event ' || CAST(event_id AS VARCHAR) AS message, epoch_us(ts) AS ts_us, strftime(ts, '%Y-%m-%d') AS date,
      json_extract_string(props, '$.k') AS shard, CASE WHEN event_type = 'error' THEN 'bad value ' || CAST(value AS VARCHAR) END AS exception_message FROM events""",
)
def _(spark, d):
    lines = log_source.format_structured_logs(parsed(spark, d))
    again = log_source.parse_structured_logs(lines)
    return again.select(
        "message",
        us("ts"),
        F.substring("timestamp", 1, 10).alias("date"),
        F.try_element_at("extra", F.lit("shard")).alias("shard"),
        F.col("exception.message").alias("exception_message"),
    )


@check(
    "log_values_round_trip",
    "",
    """SELECT 'event ' || CAST(event_id AS VARCHAR) AS message, CASE WHEN event_type IN ('click', 'error') THEN value END AS duration_ms,
      CASE WHEN event_type IN ('click', 'error') THEN 'bool' END AS success_kind, CASE WHEN event_type IN ('click', 'error') THEN event_type <> 'error' END AS success,
      CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 'string' END AS shard_kind, CASE WHEN event_type IN ('click', 'error') THEN 'string' END AS operation_kind FROM events""",
)
def _(spark, d):
    again = log_source.parse_structured_logs(log_source.format_structured_logs(parsed(spark, d)))

    def value(name, column="extra_values"):
        return F.try_element_at(column, F.lit(name))

    def kind(v):
        return F.when(v.isNotNull(), configs.variant_kind(v))

    return again.select(
        "message",
        F.try_variant_get(value("duration_ms"), "$", "double").alias("duration_ms"),
        kind(value("success")).alias("success_kind"),
        F.try_variant_get(value("success"), "$", "boolean").alias("success"),
        kind(value("shard")).alias("shard_kind"),
        kind(value("operation", "context_values")).alias("operation_kind"),
    )


PERF_SQL = """perf AS (SELECT event_id, user_id AS thread_id, 'op' || CAST(event_id % 7 AS VARCHAR) AS operation, CASE WHEN event_id % 2 = 0 THEN 'reactive' END AS cognitive_layer,
  value AS duration_ms, event_type <> 'error' AS success, event_id % 2 = 0 AS performance_metric FROM events WHERE event_type IN ('click', 'error'))"""


@check(
    "performance_records",
    "",
    f"WITH {PERF_SQL} SELECT 'event ' || CAST(event_id AS VARCHAR) AS message, thread_id, operation, cognitive_layer, duration_ms, success, performance_metric FROM perf",
)
def _(spark, d):
    out = ops.performance_records(parsed(spark, d))
    return out.select("message", "thread_id", "operation", "cognitive_layer", "duration_ms", "success", "performance_metric")


@check(
    "operation_stats",
    "",
    f"""WITH {PERF_SQL}, src AS (SELECT operation AS k, duration_ms AS v FROM perf), {SUMMARY_SQL},
    runs AS (SELECT operation, count(*) AS runs, count(*) FILTER (WHERE NOT success) AS failures FROM perf GROUP BY 1)
    SELECT operation, runs, failures, mean, median, p95, p99, round(failures / runs + 1e-9, 6) AS failure_ratio FROM runs JOIN summary ON k = operation""",
)
def _(spark, d):
    out = ops.operation_stats(ops.performance_records(parsed(spark, d)))
    return out.select("operation", "runs", "failures", *[r(c) for c in ("mean", "median", "p95", "p99", "failure_ratio")])


@check(
    "operation_stats_by_layer",
    "",
    f"""WITH {PERF_SQL} SELECT operation, cognitive_layer, count(*) AS runs, count(*) FILTER (WHERE NOT success) AS failures,
    round(avg(duration_ms) + 1e-9, 6) AS mean, round(median(duration_ms) + 1e-9, 6) AS median FROM perf GROUP BY 1, 2""",
)
def _(spark, d):
    out = ops.operation_stats(ops.performance_records(parsed(spark, d)), ["operation", "cognitive_layer"])
    return out.select("operation", "cognitive_layer", "runs", "failures", r("mean"), r("median"))


@check(
    "enrich_with_context",
    "metric",
    """WITH ev AS (SELECT user_id AS thread_id, seq, CASE name WHEN 'signup' THEN 'enter' WHEN 'purchase' THEN 'exit' ELSE 'log' END AS kind,
      row_number() OVER (PARTITION BY user_id ORDER BY ts_us, seq) AS rn FROM metric),
    walk AS (
      SELECT thread_id, rn, seq, kind, CASE WHEN kind = 'enter' THEN [seq] ELSE [] END AS stack FROM ev WHERE rn = 1
      UNION ALL
      SELECT e.thread_id, e.rn, e.seq, e.kind, CASE e.kind WHEN 'enter' THEN list_append(w.stack, e.seq) WHEN 'exit' THEN list_slice(w.stack, 1, greatest(len(w.stack) - 1, 0)) ELSE w.stack END
      FROM walk w JOIN ev e ON e.thread_id = w.thread_id AND e.rn = w.rn + 1)
    SELECT thread_id, seq, CAST(len(stack) AS INT) AS depth, 'o' || CAST(stack[len(stack)] AS VARCHAR) AS op,
      CAST(list_filter(stack, lambda s: s % 3 = 0)[-1] AS VARCHAR) AS k0 FROM walk WHERE kind = 'log'""",
    recursive=True,
)
def _(spark, d):
    m = tables.metric(spark, d)
    kind = F.when(F.col("name") == "signup", "enter").when(F.col("name") == "purchase", "exit").otherwise("log")
    entered = F.to_json(
        F.create_map(
            F.lit("op"),
            F.concat(F.lit("o"), F.col("seq").cast("string")),
            F.concat(F.lit("k"), (F.col("seq") % 3).cast("string")),
            F.col("seq").cast("string"),
        )
    )
    rows = m.select(F.col("user_id").alias("thread_id"), "ts", "seq", kind.alias("kind"), F.when(kind == "enter", entered).alias("context"))
    out = ops.enrich_with_context(rows, width="3 days")
    return out.select(
        "thread_id", "seq", "depth", F.try_element_at("context", F.lit("op")).alias("op"), F.try_element_at("context", F.lit("k0")).alias("k0")
    )


@check(
    "throttle",
    "health",
    """WITH kept AS (
      SELECT "check", min(ts_us) AS ts_us FROM health GROUP BY 1
      UNION ALL
      SELECT * FROM (SELECT k."check", (SELECT min(h.ts_us) FROM health h WHERE h."check" = k."check" AND h.ts_us >= k.ts_us + 1800000000) AS ts_us FROM kept k) WHERE ts_us IS NOT NULL)
    SELECT h."check", h.seq, k.ts_us IS NOT NULL AS kept FROM health h LEFT JOIN kept k ON k."check" = h."check" AND k.ts_us = h.ts_us""",
    recursive=True,
)
def _(spark, d):
    return throttle(tables.health(spark, d), ["check"], "30 minutes").select("check", "seq", "kept")
