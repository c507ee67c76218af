"""Summaries with exactly defined percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions.fixed import LATENCY_HISTORY, LATENCY_LIMITS_MS, lookup
from opslens.plans.ordered import first_n, width_us
from opslens.plans.quantiles import exclusive_ranks, exclusive_value, order_statistics


def samples_since(samples: DataFrame, since: Column) -> DataFrame:
    """Samples at or after a time."""
    return samples.where(F.col("ts") >= since)


def keep_last(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Bounded history: the latest n rows per key."""
    return first_n(df, keys, [F.col(c).desc() for c in order], n, rank="_rn").drop("_rn")


def metric_summary(
    samples: DataFrame, keys: Sequence[str] = ("name",), value: str = "value", counts: dict[str, Column] | None = None
) -> DataFrame:
    """count, sum, min, max, mean, median, p95, p99 and sample stddev per key, and the number
    of rows that meet each condition in ``counts``.

    p95 and p99 follow the exclusive method and may exceed the maximum.
    """
    n = F.col("n")
    ranks = {
        "mid_a": "(n + 1) div 2",
        "mid_b": "n div 2 + 1",
        **exclusive_ranks("p95", 19, 20),
        **exclusive_ranks("p99", 99, 100),
    }
    stats = order_statistics(samples, keys, F.col(value), ranks, counts)
    return stats.select(
        *keys,
        n.alias("count"),
        F.col("total").alias("sum"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        (F.col("total") / n).alias("mean"),
        ((F.col("mid_a") + F.col("mid_b")) / 2).alias("median"),
        exclusive_value("p95", 19, 20).alias("p95"),
        exclusive_value("p99", 99, 100).alias("p99"),
        F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).otherwise(0.0).alias("stddev"),
        *(counts or {}),
    )


def metric_summary_window(samples: DataFrame, width: str, as_of: Column, keys: Sequence[str] = ("name",)) -> DataFrame:
    """``metric_summary`` of the samples in the last ``width`` before ``as_of``."""
    start = F.timestamp_micros(F.unix_micros(as_of) - width_us(width))
    return metric_summary(samples_since(samples, start), keys)


def derive_latencies(tasks: DataFrame) -> DataFrame:
    """Scheduling, execution and total time in ms; null where an end is missing."""

    def ms(start: str, end: str) -> Column:
        return (F.unix_micros(end) - F.unix_micros(start)) / 1000

    return tasks.withColumns(
        {
            "scheduling_ms": ms("created_at", "scheduled_at"),
            "execution_ms": ms("started_at", "completed_at"),
            "total_ms": ms("created_at", "completed_at"),
        }
    )


def latency_series(tasks: DataFrame) -> DataFrame:
    """One row per task and kind of latency: ``priority7, kind, latency_ms, ts, seq``."""
    rows = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_ms").alias("latency_ms"), F.col(at).alias("ts"))
            for kind, at in (("scheduling", "scheduled_at"), ("execution", "completed_at"), ("total", "completed_at"))
        ]
    )
    long = derive_latencies(tasks).select("task_id", "name", "priority7", "seq", F.inline(rows))
    return long.where(F.col("latency_ms").isNotNull())


def latency_stats(tasks: DataFrame, history: int = LATENCY_HISTORY) -> DataFrame:
    """Per priority and kind: count, mean, min, max over all rows; nearest-rank p50, p95, p99
    over the latest ``history`` rows."""
    series = latency_series(tasks)
    keys = ["priority7", "kind"]
    overall = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("latency_ms").alias("mean"),
        F.min("latency_ms").alias("min"),
        F.max("latency_ms").alias("max"),
    )
    recent = keep_last(series.select(*keys, "ts", "seq", "latency_ms"), keys, history)
    # at most `history` values per key remain, so the sorted array has a fixed bound
    ordered = recent.groupBy(*keys).agg(F.sort_array(F.collect_list("latency_ms")).alias("_v"))

    def rank(p: int) -> Column:
        n = F.size("_v")
        index = F.least(F.floor(F.lit(p) * n / 100).cast("int"), n - 1)
        return F.element_at("_v", index + 1).alias(f"p{p}")

    return overall.join(ordered.select(*keys, rank(50), rank(95), rank(99)), keys)


def threshold_breaches(tasks: DataFrame) -> DataFrame:
    """Latencies strictly above the limit of their priority and kind."""
    scheduling = lookup("priority7", {p: float(v[0]) for p, v in LATENCY_LIMITS_MS.items()})
    execution = lookup("priority7", {p: float(v[1]) for p, v in LATENCY_LIMITS_MS.items()})
    limit = F.when(F.col("kind") == "scheduling", scheduling).when(F.col("kind") == "execution", execution)
    return latency_series(tasks).withColumn("threshold_ms", limit).where(F.col("latency_ms") > F.col("threshold_ms"))


def timer_durations(spans: DataFrame, start: str, end: str) -> DataFrame:
    """Durations in ms of start/end pairs, as metric samples."""
    return spans.withColumn("value", (F.unix_micros(end) - F.unix_micros(start)) / 1000)


def p95_trend(tasks: DataFrame) -> DataFrame:
    """Priorities REALTIME and CRITICAL whose scheduling p95 exceeds twice the limit."""
    limit = lookup("priority7", {p: float(v[0]) for p, v in LATENCY_LIMITS_MS.items()})
    urgent = tasks.where(F.col("priority7").isin(90, 100))
    stats = latency_stats(urgent).where(F.col("kind") == "scheduling")
    return stats.select(
        "priority7",
        F.lit("warning").alias("level"),
        "p95",
        limit.alias("threshold_ms"),
        "count",
    ).where(F.col("p95") > 2 * F.col("threshold_ms"))


def gauge_averages(ticks: DataFrame, keys: Sequence[str], history: int = LATENCY_HISTORY) -> DataFrame:
    """Mean queue size and utilisation percent over the latest ticks."""
    recent = keep_last(ticks, keys, history, order=("ts",))
    busy = F.when(F.col("total_workers") == 0, 0.0).otherwise(F.col("active_workers") / F.col("total_workers") * 100)
    return recent.groupBy(*keys).agg(
        F.avg("queue_size").alias("mean_queue_size"), F.avg(busy).alias("utilization_pct"), F.count(F.lit(1)).alias("ticks")
    )
