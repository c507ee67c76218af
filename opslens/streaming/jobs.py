"""Structured Streaming versions built from windows, deduplication and joins.

All functions take and return streaming frames (most work on batch frames too). Aggregates
are pre-combined before the shuffle by Spark, so a hot metric costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.functions.fixed import LATENCY_LIMITS_MS, lookup
from opslens.operators import alerts as alert_ops
from opslens.session import scratch_path


def read_stream(spark: SparkSession, folder: str, file: str, max_files: int = 1000, schema=None) -> DataFrame:
    """Parquet files of a folder by name or pattern as a stream."""
    schema = schema or spark.read.parquet(f"{folder}/{file}").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", file).option("maxFilesPerTrigger", max_files)
    return source.parquet(folder)


# Settings of a join of streams, which keeps each row as a state value: without a count of these (a figure of the progress
# report only) a write need not look its key up first.
JOIN_SETTINGS = {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}
JOIN_ROWS = 2_000_000  # rows per state partition of a join


def state_partitions(spark: SparkSession, *paths: str, bytes_each: int = 64 * 1024 * 1024, least: int = 8, rows_each: int | None = None) -> int:
    """Partitions for streaming state by the size of the stored input, and by its rows where each becomes a state
    value. A stream keeps the number it starts with, and adaptive execution does not change it."""
    total = 0
    if rows_each:
        least = max(least, -(-sum(spark.read.parquet(path).count() for path in paths) // rows_each))
    for path in paths:
        files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max("_metadata.file_size").alias("size"))
        total += files.agg(F.sum("size")).first()[0] or 0
    return max(least, -(-total // bytes_each))


def run_available(stream: DataFrame, label: str, partitions: int | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """Run a stream over what is there, into Parquet below the shared folder, and read it back.

    ``partitions`` sets the number of state partitions of this query only, ``settings`` other values for it.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    writer = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/state")
        .outputMode("append")
        .trigger(availableNow=True)
    )
    own = dict(settings or {})
    if partitions:
        own["spark.sql.shuffle.partitions"] = str(partitions)
    usual = {name: spark.conf.get(name, None) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        query = writer.start()
    finally:
        for name, value in usual.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def stream_metric_summary(
    samples: DataFrame,
    keys: Sequence[str] = ("name",),
    window: str = "1 minute",
    late: str = "10 minutes",
    slide: str | None = None,
    exact: bool = False,
) -> DataFrame:
    """Summary per window. p95 comes from a mergeable sketch: a value of the window whose rank is off by at
    most 1 in 10,000 rows, so exact up to 10,000 rows. With ``exact`` it is the nearest-rank value from the counts of
    all distinct values of the window, which are one state value: for values that repeat, such as whole milliseconds."""
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)") if exact else F.percentile_approx("value", 0.95, 10_000)
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = samples.withWatermark("ts", late).groupBy(at.alias("_w"), *keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("value").alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        p95.alias("p95"),
    )
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "count", "sum", "min", "max", "mean", "p95")


def stream_latency_window(
    samples: DataFrame, keys: Sequence[str] = ("name",), window: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes"
) -> DataFrame:
    """Sliding windows over latencies."""
    return stream_metric_summary(samples, keys, window, late, slide)


def stream_p95_trend(latencies: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Warnings for REALTIME and CRITICAL windows whose scheduling p95 exceeds twice the limit.

    ``latencies`` has ``priority7, ts, value`` (scheduling latency in ms). The p95 that the limit is held
    against is exact.
    """
    limit = lookup("priority7", {p: float(v[0]) for p, v in LATENCY_LIMITS_MS.items()})
    urgent = latencies.where(F.col("priority7").isin(90, 100))
    stats = stream_metric_summary(urgent, ["priority7"], window, late, exact=True)
    return stats.withColumns({"threshold_ms": limit, "level": F.lit("warning")}).where(F.col("p95") > 2 * F.col("threshold_ms"))


def stream_health_alerts(readings: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """One alert per check and minute with a bad result."""
    classed = readings.withColumn("status", alert_ops.health_class()).withWatermark("ts", late)
    return alert_ops.health_alerts(classed, window=window)


def stream_counters(events: DataFrame, keys: Sequence[str] = ("priority7",), window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Completed and failed tasks per priority and window."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("_w"), *keys).agg(
        F.count_if(F.col("event") == "completed").alias("processed"), F.count_if(F.col("event") == "failed").alias("failed")
    )
    return out.select(*keys, F.col("_w.start").alias("window_start"), "processed", "failed")


def join_task_result_stream(tasks: DataFrame, results: DataFrame, wait: str = "30 days", late: str = "1 hour") -> DataFrame:
    """Each task with the results that arrive within the wait limit, or nulls once it has passed."""
    left = tasks.select("task_id", "created_at").withWatermark("created_at", late)
    right = results.select(F.col("task_id").alias("_id"), "worker_id", "success", F.col("ts").alias("result_ts")).withWatermark("result_ts", late)
    within = (F.col("task_id") == F.col("_id")) & (F.col("result_ts") >= F.col("created_at")) & F.expr(f"result_ts <= created_at + INTERVAL {wait}")
    return left.join(right, within, "left_outer").drop("_id")
