"""Counters, gauges, histograms, as-of values, exposition text."""

from pyspark.sql import functions as F

from checks.registry import check, r, us
from opslens.functions import labels as label_fns
from opslens.operators import metrics as ops, stats
from opslens.sources import tables

COUNTER_SQL = "counter AS (SELECT event_type AS name, epoch_us(ts) AS ts_us, event_id AS seq, CAST(event_id % 500 AS DOUBLE) AS value FROM events)"
DELTA_SQL = """delta AS (SELECT *, value - lag(value) OVER w AS grown FROM counter WINDOW w AS (PARTITION BY name ORDER BY ts_us, seq)),
d AS (SELECT name, ts_us, seq, value, CASE WHEN grown < 0 THEN value ELSE grown END AS delta FROM delta)"""


@check("counter_value", "metric", "SELECT user_id, round(coalesce(sum(value - 10) FILTER (WHERE value >= 10), 0), 4) AS current, count(*) FILTER (WHERE value < 10) AS rejected FROM metric GROUP BY 1")
def _(spark, d):
    moved = tables.metric(spark, d).withColumn("value", F.col("value") - 10)
    return ops.counter_value(moved, ["user_id"]).withColumn("current", F.round("current", 4))


@check(
    "gauge_value",
    "gauge_op",
    """WITH s AS (SELECT series, max(seq) AS at FROM gauge_op WHERE op = 'set' GROUP BY 1)
    SELECT g.series, round(sum(value), 4) AS current, max(ts_us) AS ts_us FROM gauge_op g LEFT JOIN s ON g.series = s.series WHERE s.at IS NULL OR g.seq >= s.at GROUP BY 1""",
)
def _(spark, d):
    out = ops.gauge_value(tables.gauge_op(spark, d), ["series"])
    return out.select("series", F.round("current", 4).alias("current"), us("ts"))


BOUNDS = [1, 5, 10, 25, 50, 100, 250]


@check(
    "histogram_buckets",
    "metric",
    """SELECT name, CAST(b AS DOUBLE) AS bound, count(*) FILTER (WHERE value <= b) AS count, count(*) FILTER (WHERE value <= b) > 0 AS hit
    FROM metric CROSS JOIN (SELECT unnest([1, 5, 10, 25, 50, 100, 250]) AS b) GROUP BY 1, 2""",
)
def _(spark, d):
    return ops.histogram_buckets(tables.metric(spark, d), ["name"], BOUNDS)


@check("counter_series", "metric", "SELECT name, seq, round(sum(value) OVER (PARTITION BY name ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING), 4) AS total FROM metric WHERE value >= 0")
def _(spark, d):
    return ops.counter_series(tables.metric(spark, d), ["name"]).select("name", "seq", F.round("total", 4).alias("total"))


@check("counter_delta", "", f"WITH {COUNTER_SQL}, {DELTA_SQL} SELECT * FROM d")
def _(spark, d):
    out = ops.counter_delta(tables.counter_sample(spark, d), ["name"])
    return out.select("name", us("ts"), "seq", "value", "delta")


@check(
    "counter_rate",
    "",
    f"""WITH {COUNTER_SQL}, {DELTA_SQL} SELECT name, ts_us // 300000000 * 300000000 AS window_start_us, round(coalesce(sum(delta), 0) / 300 + 1e-9, 6) AS rate FROM d GROUP BY 1, 2""",
)
def _(spark, d):
    out = ops.counter_rate(tables.counter_sample(spark, d), ["name"])
    return out.select("name", us("window_start"), r("rate"))


@check(
    "latest_before",
    "metric",
    """WITH p AS (SELECT user_id, ts_us, seq FROM metric WHERE name = 'error'), s AS (SELECT user_id, ts_us, seq, value FROM metric WHERE name = 'view')
    SELECT p.user_id, p.seq, s.ts_us AS sample_us, s.value FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts_us >= s.ts_us""",
)
def _(spark, d):
    m = tables.metric(spark, d)
    probes = m.where(F.col("name") == "error").select("user_id", "ts", "seq")
    samples = m.where(F.col("name") == "view").select("user_id", "ts", "seq", "value")
    out = ops.latest_before(probes, samples, ["user_id"], ["value"])
    return out.select("user_id", "seq", us("sample_ts", "sample_us"), "value")


@check(
    "latest_before_null_keys",
    "metric",
    """WITH m AS (SELECT CASE WHEN user_id % 5 <> 0 THEN user_id END AS user_id, ts_us, seq, value, name FROM metric),
    p AS (SELECT coalesce(user_id, -1) AS k, user_id, ts_us, seq FROM m WHERE name = 'error'),
    s AS (SELECT coalesce(user_id, -1) AS k, ts_us, max_by(value, seq) AS value FROM m WHERE name = 'view' GROUP BY ALL)
    SELECT p.user_id, p.seq, s.ts_us AS sample_us, s.value FROM p ASOF LEFT JOIN s ON p.k = s.k AND p.ts_us >= s.ts_us""",
)
def _(spark, d):
    m = tables.metric(spark, d).withColumn("user_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")))
    probes = m.where(F.col("name") == "error").select("user_id", "ts", "seq")
    samples = m.where(F.col("name") == "view").select("user_id", "ts", "seq", "value")
    out = ops.latest_before(probes, samples, ["user_id"], ["value"])
    return out.select("user_id", "seq", us("sample_ts", "sample_us"), "value")


@check(
    "latest_before_fresh",
    "metric",
    """WITH p AS (SELECT user_id, ts_us, seq FROM metric WHERE name = 'error'), s AS (SELECT user_id, ts_us, seq, value FROM metric WHERE name = 'view'),
    j AS (SELECT p.user_id, p.seq, p.ts_us, s.ts_us AS sample_us, s.value FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts_us >= s.ts_us)
    SELECT user_id, seq, CASE WHEN ts_us - sample_us < 7200000000 THEN sample_us END AS sample_us, CASE WHEN ts_us - sample_us < 7200000000 THEN value END AS value FROM j""",
)
def _(spark, d):
    m = tables.metric(spark, d)
    probes = m.where(F.col("name") == "error").select("user_id", "ts", "seq")
    samples = m.where(F.col("name") == "view").select("user_id", "ts", "seq", "value")
    out = ops.latest_before(probes, samples, ["user_id"], ["value"], max_age_us=7_200_000_000)
    return out.select("user_id", "seq", us("sample_ts", "sample_us"), "value")


@check("registered_metrics", "metric", "SELECT DISTINCT name, CASE WHEN name IN ('error', 'signup') THEN 'counter' ELSE 'gauge' END AS type FROM metric")
def _(spark, d):
    kind = F.when(F.col("name").isin("error", "signup"), "counter").otherwise("gauge")
    return ops.registered_metrics(tables.metric(spark, d).withColumn("type", kind))


@check(
    "labels",
    "metric",
    """SELECT seq, '{host="h' || CAST(user_id % 9 AS VARCHAR) || '",type="' || name || '",user="' || CAST(user_id AS VARCHAR) || '"}' AS labels FROM metric""",
)
def _(spark, d):
    m = tables.metric(spark, d)
    base = F.map_concat("labels", F.create_map(F.lit("type"), F.lit("none")))
    extra = F.create_map(F.lit("type"), F.col("name"), F.lit("host"), F.concat(F.lit("h"), (F.col("user_id") % 9).cast("string")))
    return m.select("seq", label_fns.format_labels(label_fns.merge_labels(base, extra)).alias("labels"))


@check(
    "export_prometheus",
    "metric",
    """WITH t AS (SELECT name, user_id, count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS s FROM metric GROUP BY 1, 2),
    cur AS (SELECT name, user_id, CAST(n AS VARCHAR) || '.0' AS v, '{user="' || CAST(user_id AS VARCHAR) || '"}' AS l FROM t WHERE name IN ('error', 'signup')),
    b AS (SELECT name, b, count(*) FILTER (WHERE value <= b) AS c FROM metric CROSS JOIN (SELECT unnest([1, 5, 10, 25, 50, 100, 250]) AS b) WHERE name = 'view' GROUP BY 1, 2),
    tot AS (SELECT name, count(*) AS c FROM metric WHERE name = 'view' GROUP BY 1),
    kind AS (SELECT DISTINCT name, CASE WHEN name IN ('error', 'signup') THEN 'counter' WHEN name = 'view' THEN 'histogram' ELSE 'timer' END AS type FROM metric)
    SELECT name, 0 AS section, '' AS series, CAST(NULL AS DOUBLE) AS bound, '# HELP ' || name || ' events of type ' || name AS line FROM kind
    UNION ALL SELECT name, 1, '', NULL, '# TYPE ' || name || ' ' || type FROM kind
    UNION ALL SELECT name, 9, '', NULL, '' FROM kind
    UNION ALL SELECT name, 2, l, NULL, name || l || ' ' || v FROM cur
    UNION ALL SELECT name, 3, '', b, name || '_bucket{le="' || CAST(b AS VARCHAR) || '.0"} ' || CAST(c AS VARCHAR) FROM b WHERE c > 0
    UNION ALL SELECT name, 4, '', NULL, name || '_count ' || CAST(c AS VARCHAR) FROM tot
    UNION ALL SELECT name, 5, '', NULL, name || '_sum ' || CAST(c * 2 AS VARCHAR) || '.0' FROM tot""",
)
def _(spark, d):
    m = tables.metric(spark, d)
    kind = F.when(F.col("name").isin("error", "signup"), "counter").when(F.col("name") == "view", "histogram").otherwise("timer")
    kinds = ops.registered_metrics(m.withColumn("type", kind))
    kinds = kinds.withColumn("description", F.concat(F.lit("events of type "), F.col("name")))
    counted = m.where(F.col("name").isin("error", "signup")).withColumn("value", F.lit(1.0))
    current = ops.counter_value(counted, ["name", "user_id"]).select(
        "name", F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"), F.col("current").alias("value")
    )
    views = m.where(F.col("name") == "view")
    no_labels = F.create_map().cast("map<string,string>")
    buckets = ops.histogram_buckets(views, ["name"], BOUNDS).withColumn("labels", no_labels)
    totals = views.groupBy("name").agg(F.count(F.lit(1)).alias("count"), F.sum(F.lit(2.0)).alias("sum")).withColumn("labels", no_labels)
    return ops.exposition_lines(kinds, current, buckets, totals)


@check(
    "metrics_overview",
    "metric",
    """WITH k AS (SELECT *, CASE WHEN name IN ('error', 'signup') THEN 'counter' WHEN name = 'view' THEN 'gauge' ELSE 'histogram' END AS type FROM metric),
    s AS (SELECT name, max(seq) AS set_seq FROM k WHERE type = 'gauge' AND seq % 100 = 0 GROUP BY 1)
    SELECT k.name, type, count(*) AS count, round(avg(value) + 1e-9, 6) AS mean, max(value) AS max,
      CASE type WHEN 'counter' THEN round(sum(value), 4) WHEN 'gauge' THEN round(sum(value) FILTER (WHERE k.seq >= s.set_seq), 4) END AS current
    FROM k LEFT JOIN s ON k.name = s.name GROUP BY k.name, type""",
)
def _(spark, d):
    kind = F.when(F.col("name").isin("error", "signup"), "counter").when(F.col("name") == "view", "gauge").otherwise("histogram")
    op = F.when((F.col("name") == "view") & (F.col("seq") % 100 == 0), "set").otherwise("increment")
    out = ops.metrics_overview(tables.metric(spark, d).withColumns({"type": kind, "op": op}))
    return out.select("name", "type", "count", r("mean"), "max", F.round("current", 4).alias("current"))
