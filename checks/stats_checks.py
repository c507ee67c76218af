"""Summaries and percentiles."""

from pyspark.sql import functions as F

from checks.registry import as_of_events, check, r, us
from opslens.operators import stats
from opslens.sources import tables

# exact twin of the exclusive quantile and the summary over rows (k, v)
SUMMARY_SQL = """
ranked AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS rn, count(*) OVER (PARTITION BY k) AS n FROM src),
pos AS (SELECT k, any_value(n) AS n,
  greatest(1, least((19 * (any_value(n) + 1)) // 20, any_value(n) - 1)) AS j95,
  greatest(1, least((99 * (any_value(n) + 1)) // 100, any_value(n) - 1)) AS j99 FROM ranked GROUP BY k),
summary AS (SELECT r.k, p.n AS count, round(sum(v), 4) AS sum, min(v) AS min, max(v) AS max, round(avg(v) + 1e-9, 6) AS mean,
  round(median(v) + 1e-9, 6) AS median,
  round(CASE WHEN p.n = 1 THEN max(v) ELSE (max(CASE WHEN rn = j95 THEN v END) * (20 - (19 * (p.n + 1) - j95 * 20))
    + max(CASE WHEN rn = j95 + 1 THEN v END) * (19 * (p.n + 1) - j95 * 20)) / 20 END + 1e-9, 6) AS p95,
  round(CASE WHEN p.n = 1 THEN max(v) ELSE (max(CASE WHEN rn = j99 THEN v END) * (100 - (99 * (p.n + 1) - j99 * 100))
    + max(CASE WHEN rn = j99 + 1 THEN v END) * (99 * (p.n + 1) - j99 * 100)) / 100 END + 1e-9, 6) AS p99,
  round(coalesce(stddev_samp(v), 0) + 1e-9, 6) AS stddev
  FROM ranked r JOIN pos p ON r.k = p.k GROUP BY r.k, p.n, p.j95, p.j99)
"""
SUMMARY_COLUMNS = ["mean", "median", "p95", "p99", "stddev"]


def rounded_summary(df, key):
    return df.select(
        F.col(key), "count", F.round("sum", 4).alias("sum"), "min", "max", *[r(c) for c in SUMMARY_COLUMNS]
    )


@check("metric_summary", "metric", f"WITH src AS (SELECT name AS k, value AS v FROM metric), {SUMMARY_SQL} SELECT k AS name, * EXCLUDE (k) FROM summary")
def _(spark, d):
    return rounded_summary(stats.metric_summary(tables.metric(spark, d)), "name")


@check("metric_summary_by_series", "metric", f"WITH src AS (SELECT user_id AS k, value AS v FROM metric), {SUMMARY_SQL} SELECT k AS user_id, * EXCLUDE (k) FROM summary")
def _(spark, d):
    return rounded_summary(stats.metric_summary(tables.metric(spark, d), ["user_id"]), "user_id")


@check(
    "metric_summary_window",
    "metric",
    f"WITH src AS (SELECT name AS k, value AS v FROM metric WHERE ts_us >= {{as_of_events}} - 7 * 86400000000), {SUMMARY_SQL} SELECT k AS name, * EXCLUDE (k) FROM summary",
)
def _(spark, d):
    return rounded_summary(stats.metric_summary_window(tables.metric(spark, d), "7 days", as_of_events()), "name")


@check("samples_since", "metric", "SELECT name, ts_us, seq, value FROM metric WHERE ts_us >= {as_of_events}")
def _(spark, d):
    return stats.samples_since(tables.metric(spark, d), as_of_events()).select("name", us("ts"), "seq", "value")


@check(
    "keep_last",
    "metric",
    "SELECT name, ts_us, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts_us DESC, seq DESC) AS rn FROM metric) WHERE rn <= 1000",
)
def _(spark, d):
    return stats.keep_last(tables.metric(spark, d), ["name"], 1000).select("name", us("ts"), "seq", "value")


@check(
    "timer_durations",
    "task",
    f"WITH src AS (SELECT pool AS k, (completed_us - started_us) / 1000.0::DOUBLE AS v FROM task WHERE completed_us IS NOT NULL), {SUMMARY_SQL} SELECT k AS pool, * EXCLUDE (k) FROM summary",
)
def _(spark, d):
    spans = stats.timer_durations(tables.task(spark, d), "started_at", "completed_at")
    return rounded_summary(stats.metric_summary(spans, ["pool"]), "pool")


@check(
    "derive_latencies",
    "task",
    """SELECT task_id, (scheduled_us - created_us) / 1000.0::DOUBLE AS scheduling_ms, (completed_us - started_us) / 1000.0::DOUBLE AS execution_ms,
    (completed_us - created_us) / 1000.0::DOUBLE AS total_ms FROM task""",
)
def _(spark, d):
    return stats.derive_latencies(tables.task(spark, d)).select("task_id", "scheduling_ms", "execution_ms", "total_ms")


LATENCY_SQL = """
WITH recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY priority7, kind ORDER BY ts_us DESC, seq DESC) AS back FROM latency) WHERE back <= 1000),
ranked AS (SELECT priority7, kind, latency_ms, row_number() OVER (PARTITION BY priority7, kind ORDER BY latency_ms) - 1 AS i,
  count(*) OVER (PARTITION BY priority7, kind) AS n FROM recent),
pct AS (SELECT priority7, kind, max(CASE WHEN i = least(50 * n // 100, n - 1) THEN latency_ms END) AS p50,
  max(CASE WHEN i = least(95 * n // 100, n - 1) THEN latency_ms END) AS p95,
  max(CASE WHEN i = least(99 * n // 100, n - 1) THEN latency_ms END) AS p99 FROM ranked GROUP BY 1, 2),
stat AS (SELECT priority7, kind, count(*) AS count, round(avg(latency_ms) + 1e-9, 6) AS mean, min(latency_ms) AS min, max(latency_ms) AS max
  FROM latency GROUP BY 1, 2)
"""


@check("latency_stats", "latency", LATENCY_SQL + " SELECT stat.*, p50, p95, p99 FROM stat JOIN pct USING (priority7, kind)")
def _(spark, d):
    return stats.latency_stats(tables.task(spark, d)).withColumn("mean", r("mean"))


@check(
    "threshold_breaches",
    "latency",
    """SELECT * FROM (SELECT task_id, priority7, kind, latency_ms, CASE kind
      WHEN 'scheduling' THEN CASE priority7 WHEN 100 THEN 10.0 WHEN 90 THEN 50.0 WHEN 80 THEN 100.0 WHEN 50 THEN 500.0 END
      WHEN 'execution' THEN CASE priority7 WHEN 100 THEN 100.0 WHEN 90 THEN 500.0 WHEN 80 THEN 1000.0 WHEN 50 THEN 5000.0 END END::DOUBLE AS threshold_ms
    FROM latency) WHERE latency_ms > threshold_ms""",
)
def _(spark, d):
    return stats.threshold_breaches(tables.task(spark, d)).select("task_id", "priority7", "kind", "latency_ms", "threshold_ms")


@check(
    "p95_trend_alert",
    "latency",
    LATENCY_SQL
    + """ SELECT priority7, 'warning' AS level, p95, CASE priority7 WHEN 100 THEN 10.0 ELSE 50.0 END::DOUBLE AS threshold_ms, count
    FROM stat JOIN pct USING (priority7, kind) WHERE kind = 'scheduling' AND priority7 IN (90, 100)
    AND p95 > 2 * CASE priority7 WHEN 100 THEN 10.0 ELSE 50.0 END""",
)
def _(spark, d):
    return stats.p95_trend(tables.task(spark, d))


@check(
    "gauge_averages",
    "pool_tick",
    """SELECT task_type, round(avg(queue_size) + 1e-9, 6) AS mean_queue_size, round(avg(active_workers / total_workers * 100) + 1e-9, 6) AS utilization_pct, count(*) AS ticks
    FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY ts_us DESC) AS rn FROM pool_tick) WHERE rn <= 1000 GROUP BY 1""",
)
def _(spark, d):
    out = stats.gauge_averages(tables.pool_tick(spark, d), ["task_type"])
    return out.select("task_type", r("mean_queue_size"), r("utilization_pct"), "ticks")
