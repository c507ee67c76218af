"""Counters, gauges, histograms and values as of a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions.fixed import HISTOGRAM_BOUNDS
from opslens.functions.labels import format_labels, merge_labels, number_text
from opslens.operators.stats import metric_summary
from opslens.plans.ordered import last_before, previous, running_sum, time_chunk, width_us


def registered_metrics(samples: DataFrame) -> DataFrame:
    """Distinct metric names and types."""
    return samples.select("name", "type").distinct()


def counter_value(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the increments per counter; negative increments are rejected and counted."""
    ok = F.col("value") >= 0
    return samples.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(ok, F.col("value"))), F.lit(0.0)).alias("current"), F.count_if(~ok).alias("rejected")
    )


def gauge_value(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value of a gauge after its last ``set`` and the increments since."""
    keys = list(keys)
    at = F.struct("ts", "seq")
    last_set = ops.where(F.col("op") == "set").groupBy(*keys).agg(F.max(at).alias("_at"))
    live = ops.join(last_set, keys, "left").where(F.col("_at").isNull() | (at >= F.col("_at")))
    return live.groupBy(*keys).agg(F.sum("value").alias("current"), F.max("ts").alias("ts"))


def histogram_buckets(samples: DataFrame, keys: Sequence[str], bounds: Sequence[float] = HISTOGRAM_BOUNDS) -> DataFrame:
    """Cumulative bucket counts: a value counts in every bucket whose bound it does not exceed.

    One conditional count per bound, so rows are never multiplied.
    """
    counts = samples.groupBy(*keys).agg(*[F.count_if(F.col("value") <= b).alias(f"_b{i}") for i, b in enumerate(bounds)])
    rows = F.array(
        *[
            F.struct(F.lit(float(b)).alias("bound"), F.col(f"_b{i}").alias("count"), (F.col(f"_b{i}") > 0).alias("hit"))
            for i, b in enumerate(bounds)
        ]
    )
    return counts.select(*keys, F.inline(rows))


def counter_series(samples: DataFrame, keys: Sequence[str], width: str = "1 hour") -> DataFrame:
    """Running total of a counter at every increment."""
    good = samples.where(F.col("value") >= 0)
    return running_sum(good, keys, ["ts", "seq"], F.col("value"), time_chunk("ts", width), "total")


def counter_delta(samples: DataFrame, keys: Sequence[str], width: str = "1 hour") -> DataFrame:
    """Increase since the sample before; after a reset the value itself, null on the first."""
    stepped = previous(samples, keys, ["ts", "seq"], ["value"], time_chunk("ts", width), "_prev")
    grown = F.col("value") - F.col("_prev.value")
    delta = F.when(F.col("_prev").isNotNull(), F.when(grown < 0, F.col("value")).otherwise(grown))
    return stepped.withColumn("delta", delta).drop("_prev")


def counter_rate(samples: DataFrame, keys: Sequence[str], window: str = "5 minutes", width: str = "1 hour") -> DataFrame:
    """Increase per second and window of time."""
    seconds = width_us(window) / 1_000_000
    deltas = counter_delta(samples, keys, width)
    return (
        deltas.groupBy(*keys, F.window("ts", window).alias("_w"))
        .agg((F.coalesce(F.sum("delta"), F.lit(0.0)) / seconds).alias("rate"))
        .select(*keys, F.col("_w.start").alias("window_start"), "rate")
    )


def latest_before(
    probes: DataFrame, samples: DataFrame, keys: Sequence[str], columns: Sequence[str], width: str = "1 hour", max_age_us: int | None = None
) -> DataFrame:
    """For every probe the latest sample of its key at or before it (as-of join).

    ``probes`` needs ``keys, ts, seq``; ``samples`` needs ``keys, ts, seq`` and ``columns``.
    Both are ordered together, so no range join and no pairs.
    """
    keys = list(keys)
    names = [c for c in probes.columns if c not in (*keys, "ts", "seq")]
    seen = F.struct(F.col("ts").alias("sample_ts"), *columns)
    right = samples.select(*keys, "ts", "seq", F.lit(0).alias("_side"), seen.alias("_sample"))
    left = probes.select(*keys, "ts", "seq", F.lit(1).alias("_side"), *names)
    both = left.unionByName(right, allowMissingColumns=True)
    found = last_before(both, keys, ["ts", "_side", "seq"], F.col("_sample"), time_chunk("ts", width), "_found")
    out = found.where(F.col("_side") == 1)
    fresh = F.col("_found")
    if max_age_us is not None:
        age = F.unix_micros("ts") - F.unix_micros("_found.sample_ts")
        fresh = F.when(age < max_age_us, F.col("_found"))
    out = out.withColumn("_found", fresh)
    return out.select(*keys, "ts", "seq", *names, "_found.sample_ts", *[f"_found.{c}" for c in columns])


def metrics_overview(samples: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Summary of every metric with its type, and the current value of counters and gauges.

    ``samples`` has ``keys, type, ts, seq, op, value``; ``op`` is ``set`` or ``increment``.
    """
    keys = list(keys)
    kinds = samples.groupBy(*keys).agg(F.min("type").alias("type"))
    counters = counter_value(samples.where(F.col("type") == "counter"), keys).select(*keys, "current")
    gauges = gauge_value(samples.where(F.col("type") == "gauge"), keys).select(*keys, "current")
    return metric_summary(samples, keys).join(kinds, keys).join(counters.unionByName(gauges), keys, "left")


def exposition_lines(
    metrics: DataFrame, current: DataFrame | None = None, buckets: DataFrame | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """Text exposition rows ``(name, section, series, bound, line)``.

    ``metrics(name, type, description)``; ``current(name, labels, value)`` of counters and
    gauges; ``buckets(name, labels, bound, count)`` and ``totals(name, labels, count, sum)`` of
    histograms. A timer has only its HELP and TYPE lines.
    """

    def rows(df: DataFrame, section: int, series: Column, bound: Column, line: Column) -> DataFrame:
        return df.select(
            "name", F.lit(section).alias("section"), series.alias("series"), bound.alias("bound"), line.alias("line")
        )

    none, empty = F.lit(None).cast("double"), F.lit("")
    name = F.col("name")
    out = rows(metrics, 0, empty, none, F.concat(F.lit("# HELP "), name, F.lit(" "), F.col("description")))
    out = out.unionByName(rows(metrics, 1, empty, none, F.concat(F.lit("# TYPE "), name, F.lit(" "), F.col("type"))))
    out = out.unionByName(rows(metrics, 9, empty, none, empty))
    if current is not None:
        text = format_labels("labels")
        out = out.unionByName(rows(current, 2, text, none, F.concat(name, text, F.lit(" "), number_text(F.col("value")))))
    if buckets is not None:
        le = F.create_map(F.lit("le"), number_text(F.col("bound")))
        text = format_labels(merge_labels(F.col("labels"), le))
        hit = buckets.where(F.col("count") > 0)
        out = out.unionByName(
            rows(hit, 3, format_labels("labels"), F.col("bound"), F.concat(name, F.lit("_bucket"), text, F.lit(" "), F.col("count").cast("string")))
        )
    if totals is not None:
        text = format_labels("labels")
        out = out.unionByName(rows(totals, 4, text, none, F.concat(name, F.lit("_count"), text, F.lit(" "), F.col("count").cast("string"))))
        out = out.unionByName(rows(totals, 5, text, none, F.concat(name, F.lit("_sum"), text, F.lit(" "), number_text(F.col("sum")))))
    return out


def write_exposition(lines: DataFrame, path: str) -> None:
    """Write exposition rows in order as text."""
    lines.orderBy("name", "section", "series", "bound").select("line").write.mode("overwrite").text(path)
