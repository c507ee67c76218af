"""Health, alert records, threshold rules."""

from pyspark.sql import functions as F

from checks.registry import as_of_events, check, us
from opslens.operators import alerts as ops
from opslens.sources import tables


def classed(spark, d):
    return tables.health(spark, d).withColumn("status", ops.health_class())


@check("health_class", "health_class", 'SELECT host, "check", seq, percent, status FROM health_class')
def _(spark, d):
    return classed(spark, d).select("host", "check", "seq", "percent", "status")


@check(
    "health_message",
    "health_class",
    """SELECT seq, CASE "check" WHEN 'cpu' THEN 'CPU' ELSE 'Memory' END || ' usage ' || CASE status WHEN 'unhealthy' THEN 'critical' WHEN 'degraded' THEN 'high' ELSE 'normal' END
    || ': ' || CAST(percent AS VARCHAR) || '%' AS message FROM health_class""",
)
def _(spark, d):
    return tables.health(spark, d).select("seq", ops.health_message().alias("message"))


@check(
    "overall_health",
    "health_class",
    """WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, "check" ORDER BY ts_us DESC, seq DESC) AS rn FROM health_class) WHERE rn = 1),
    w AS (SELECT host, max(CASE status WHEN 'unhealthy' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) AS worst,
      string_agg("check" || '=' || status, ',' ORDER BY "check") AS checks FROM last GROUP BY 1)
    SELECT host, checks, (['healthy', 'degraded', 'unhealthy'])[worst + 1] AS status, CASE WHEN worst = 0 THEN 200 ELSE 503 END AS code FROM w""",
)
def _(spark, d):
    out = ops.overall_health(ops.latest_checks(classed(spark, d)))
    pairs = F.transform("checks", lambda c: F.concat(c.check, F.lit("="), c.status))
    return out.withColumn("checks", F.array_join(pairs, ","))


@check(
    "custom_health_rules",
    "metric",
    """SELECT seq, 'value' AS "check", CASE WHEN value > 100 THEN 'unhealthy' WHEN value > 50 THEN 'degraded' ELSE 'healthy' END AS status, CAST(NULL AS VARCHAR) AS message FROM metric
    UNION ALL SELECT seq, 'ratio', CASE WHEN seq % 4 = 0 THEN 'unhealthy' WHEN value / (seq % 4) > 30 THEN 'unhealthy' ELSE 'healthy' END,
      CASE WHEN seq % 4 = 0 THEN 'Health check failed: no value' END FROM metric""",
)
def _(spark, d):
    book = ops.RuleBook()
    book.register_rule("value", F.col("value") > 100, F.col("value") > 50)
    book.register_rule("ratio", F.try_divide(F.col("value"), F.col("seq") % 4) > 30)
    return book.evaluate(tables.metric(spark, d), ["seq"])


@check(
    "health_alerts",
    "health_class",
    """SELECT host, 'health_check.' || "check" AS source, ts_us // 60000000 * 60000000 AS window_start_us,
    CASE max(CASE status WHEN 'unhealthy' THEN 2 ELSE 1 END) WHEN 2 THEN 'error' ELSE 'warning' END AS level, count(*) AS results
    FROM health_class WHERE status <> 'healthy' GROUP BY 1, 2, 3""",
)
def _(spark, d):
    return ops.health_alerts(classed(spark, d)).select("host", "source", us("window_start"), "level", "results")


@check("alerts", "alert_event", "SELECT alert_id, level, source, ts_us FROM alert_event WHERE op = 'create' AND ts_us >= {as_of_events} AND level = 'error'")
def _(spark, d):
    return ops.alerts(tables.alert_event(spark, d), as_of_events(), "error").select("alert_id", "level", "source", us("ts"))


@check(
    "active_alerts",
    "alert_event",
    """SELECT alert_id, level, source, ts_us FROM alert_event WHERE op = 'create' AND ts_us <= {as_of_events}
    AND alert_id NOT IN (SELECT alert_id FROM alert_event WHERE op = 'resolve' AND ts_us <= {as_of_events})""",
)
def _(spark, d):
    return ops.active_alerts(tables.alert_event(spark, d), as_of_events()).select("alert_id", "level", "source", us("ts"))


@check("expire_results", "metric", "SELECT seq, ts_us FROM metric WHERE {as_of_events} - ts_us <= 3600000000")
def _(spark, d):
    return ops.expire_results(tables.metric(spark, d), as_of_events()).select("seq", us("ts"))


@check(
    "expire_alerts",
    "alert_event",
    """WITH s AS (SELECT alert_id, any_value(level) AS level, any_value(source) AS source, min(ts_us) FILTER (WHERE op = 'create') AS created_us,
      min(ts_us) FILTER (WHERE op = 'resolve') AS resolved_us FROM alert_event GROUP BY 1)
    SELECT * FROM s WHERE {as_of_events} - coalesce(resolved_us, created_us) <= 86400000000""",
)
def _(spark, d):
    out = ops.expire_alerts(ops.alert_state(tables.alert_event(spark, d)), as_of_events())
    return out.select("alert_id", "level", "source", us("created_at"), us("resolved_at"))


RULE_SQL = """rule AS (SELECT * FROM (VALUES ('HighView', 'view', NULL, '>', 50.0, 3600), ('HighClick', 'click', 7, '>', 75.0, 7200), ('HighError', 'error', NULL, '>', 20.0, 18000),
  ('LowSignup', 'signup', NULL, '<', 125.0, 36000), ('HighPurchase', 'purchase', NULL, '>=', 10.0, 3600)) AS t(rule, metric, "user", cmp, threshold, hold)),
matched AS (SELECT r.rule, m.user_id, m.ts_us, m.seq, m.value, r.hold, CASE r.cmp WHEN '>' THEN m.value > r.threshold WHEN '<' THEN m.value < r.threshold ELSE m.value >= r.threshold END AS breach
  FROM metric m JOIN rule r ON m.name = r.metric WHERE r."user" IS NULL OR r."user" = m.user_id)"""
RUN_SQL = RULE_SQL + """, run AS (SELECT *, count(*) FILTER (WHERE NOT breach) OVER (PARTITION BY rule, user_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING) AS grp FROM matched),
held AS (SELECT *, min(ts_us) FILTER (WHERE breach) OVER (PARTITION BY rule, user_id, grp) AS since_us FROM run)"""


@check("match_alert_rules", "metric", f"WITH {RULE_SQL} SELECT rule, seq, value, breach FROM matched")
def _(spark, d):
    return ops.match_alert_rules(tables.metric(spark, d), tables.alert_rule(spark)).select("rule", "seq", "value", "breach")


@check("alert_for", "metric", f"WITH {RUN_SQL} SELECT rule, user_id, seq, since_us FROM held WHERE breach AND ts_us - since_us >= hold * 1000000::BIGINT")
def _(spark, d):
    return ops.alert_for(tables.metric(spark, d), tables.alert_rule(spark)).select("rule", "user_id", "seq", us("since"))


@check(
    "alert_episodes",
    "metric",
    f"""WITH {RUN_SQL}, nxt AS (SELECT rule, user_id, grp, min(ts_us) AS first_us FROM held WHERE NOT breach GROUP BY 1, 2, 3)
    SELECT h.rule, '{{user="' || CAST(h.user_id AS VARCHAR) || '"}}' AS series, h.since_us, min(h.ts_us) FILTER (WHERE h.ts_us - h.since_us >= h.hold * 1000000::BIGINT) AS fired_us,
      count(*) AS samples, any_value(n.first_us) AS resolved_us
    FROM held h LEFT JOIN nxt n ON n.rule = h.rule AND n.user_id = h.user_id AND n.grp = h.grp + 1 WHERE h.breach GROUP BY 1, 2, 3""",
)
def _(spark, d):
    out = ops.alert_episodes(tables.metric(spark, d), tables.alert_rule(spark))
    return out.select("rule", "series", us("since"), us("fired_at"), "samples", us("resolved_at"))
