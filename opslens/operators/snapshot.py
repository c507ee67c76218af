"""State of every fleet member: metric summaries, health, active alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opslens.operators.alerts import active_alerts, health_class, latest_checks
from opslens.operators.stats import metric_summary
from opslens.sources import tables


def metrics_snapshot(summary: DataFrame, checks: DataFrame, alerts: DataFrame, as_of: Column, key: str = "member") -> DataFrame:
    """Snapshot rows ``(member, taken_at, section, item)`` with one JSON item per metric, check
    and open alert. Written partitioned or sorted by member they form one document each; no
    member's open alerts are gathered in one row, however many there are."""

    def section(df: DataFrame, name: str) -> DataFrame:
        row = F.to_json(F.struct(*[c for c in df.columns if c != key]))
        return df.select(key, as_of.alias("taken_at"), F.lit(name).alias("section"), row.alias("item"))

    return section(summary, "metrics").unionByName(section(checks, "health")).unionByName(section(alerts, "alerts"))


def write_snapshot(snapshot: DataFrame, path: str, key: str = "member") -> None:
    """Snapshot items in member and section order, one JSON object per line."""
    line = F.to_json(F.struct(key, "taken_at", "section", "item"))
    ordered = snapshot.orderBy(key, "section", "item")
    ordered.select(line.alias("value")).write.mode("overwrite").text(path)


def fleet_snapshot(spark: SparkSession, folder: str, as_of: Column) -> DataFrame:
    """Snapshot of every member (user) of the test tables."""
    samples = tables.metric(spark, folder).withColumnRenamed("user_id", "member")
    summary = metric_summary(samples, ["member", "name"])
    classed = tables.health(spark, folder).withColumn("status", health_class()).withColumnRenamed("host", "member")
    checks = latest_checks(classed, ["member"])
    open_alerts = active_alerts(tables.alert_event(spark, folder))
    owner = tables.metric(spark, folder).select(F.col("seq").alias("alert_id"), F.col("user_id").alias("member"))
    alerts = open_alerts.join(owner, "alert_id").select("member", "alert_id", "level", "source", "ts")
    return metrics_snapshot(summary, checks, alerts, as_of)
