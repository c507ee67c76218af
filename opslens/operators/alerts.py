"""Health classes, threshold rules with a hold time, alert records."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from opslens.functions.fixed import ALERT_RULES, HEALTH_LIMITS, HEALTH_RANK, RULE_SCHEMA, lookup
from opslens.functions.labels import format_labels
from opslens.plans.ordered import previous, time_chunk


# ---------------------------------------------------------------- health


def health_class(check: str = "check", percent: str = "percent") -> Column:
    """Status of a percent reading by the limits of its check (strictly above)."""
    warn = lookup(check, {k: v[0] for k, v in HEALTH_LIMITS.items()})
    bad = lookup(check, {k: v[1] for k, v in HEALTH_LIMITS.items()})
    value = F.col(percent)
    return F.when(value > bad, "unhealthy").when(value > warn, "degraded").otherwise("healthy")


def health_message(check: str = "check", percent: str = "percent") -> Column:
    title = F.when(F.col(check) == "cpu", "CPU").otherwise(F.initcap(F.col(check)))
    warn = lookup(check, {k: v[0] for k, v in HEALTH_LIMITS.items()})
    bad = lookup(check, {k: v[1] for k, v in HEALTH_LIMITS.items()})
    word = F.when(F.col(percent) > bad, "critical").when(F.col(percent) > warn, "high").otherwise("normal")
    return F.concat(title, F.lit(" usage "), word, F.lit(": "), F.col(percent).cast("string"), F.lit("%"))


def latest_checks(results: DataFrame, keys: Sequence[str] = ("host",)) -> DataFrame:
    """Latest result per check."""
    return results.groupBy(*keys, "check").agg(F.max_by(F.struct("ts", "status", "percent"), F.struct("ts", "seq")).alias("_r")).select(
        *keys, "check", "_r.*"
    )


def overall_health(checks: DataFrame, keys: Sequence[str] = ("host",)) -> DataFrame:
    """Worst status over the latest result of every check, the list of checks, HTTP code."""
    rank = lookup("status", HEALTH_RANK)
    # the list has one entry per kind of check
    out = checks.groupBy(*keys).agg(
        F.max(rank).alias("_worst"), F.sort_array(F.collect_list(F.struct("check", "status"))).alias("checks")
    )
    status = lookup("_worst", {v: k for k, v in HEALTH_RANK.items()})
    return out.withColumn("status", status).withColumn("code", F.when(F.col("_worst") == 0, 200).otherwise(503)).drop("_worst")


class RuleBook:
    """Named health rules as column expressions over a sample table."""

    def __init__(self) -> None:
        self.rules: dict[str, tuple[Column, Column]] = {}

    def register_rule(self, name: str, unhealthy: Column, degraded: Column | None = None) -> None:
        self.rules[name] = (unhealthy, F.lit(False) if degraded is None else degraded)

    def evaluate(self, samples: DataFrame, keep: Sequence[str]) -> DataFrame:
        """One row per sample and rule; a rule that cannot be computed is unhealthy."""
        rows = []
        for name, (bad, warn) in self.rules.items():
            failed = bad.isNull()
            status = (
                F.when(failed, "unhealthy").when(bad, "unhealthy").when(F.coalesce(warn, F.lit(False)), "degraded").otherwise("healthy")
            )
            message = F.when(failed, F.lit("Health check failed: no value"))
            rows.append(F.struct(F.lit(name).alias("check"), status.alias("status"), message.alias("message")))
        return samples.select(*keep, F.inline(F.array(*rows)))


def health_alerts(results: DataFrame, keys: Sequence[str] = ("host",), window: str = "1 minute") -> DataFrame:
    """One alert per check and minute in which it was unhealthy (error) or degraded (warning).

    Works on batch and streaming frames alike.
    """
    bad = results.where(F.col("status") != "healthy")
    rank = lookup("status", HEALTH_RANK)
    worst = bad.groupBy(F.window("ts", window).alias("_w"), *keys, "check").agg(F.max(rank).alias("_worst"), F.count(F.lit(1)).alias("results"))
    return worst.select(
        *keys,
        F.concat(F.lit("health_check."), F.col("check")).alias("source"),
        F.col("_w.start").alias("window_start"),
        F.when(F.col("_worst") == 2, "error").otherwise("warning").alias("level"),
        "results",
    )


# ---------------------------------------------------------------- alert records


def alert_state(events: DataFrame) -> DataFrame:
    """One row per alert with its creation and resolution time."""
    return events.groupBy("alert_id").agg(
        F.max_by("level", F.col("op") == "create").alias("level"),
        F.max_by("source", F.col("op") == "create").alias("source"),
        F.min(F.when(F.col("op") == "create", F.col("ts"))).alias("created_at"),
        F.min(F.when(F.col("op") == "resolve", F.col("ts"))).alias("resolved_at"),
    )


def alerts(events: DataFrame, since: Column | None = None, level: str | None = None) -> DataFrame:
    """Created alerts, optionally at or after a time and of one level."""
    out = events.where(F.col("op") == "create")
    if since is not None:
        out = out.where(F.col("ts") >= since)
    return out if level is None else out.where(F.col("level") == level)


def active_alerts(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Alerts without a resolve event (up to ``as_of``)."""
    seen = events if as_of is None else events.where(F.col("ts") <= as_of)
    resolved = seen.where(F.col("op") == "resolve").select("alert_id")
    return seen.where(F.col("op") == "create").join(resolved, "alert_id", "left_anti")


def expire_results(results: DataFrame, as_of: Column, ttl_us: int = 3_600_000_000) -> DataFrame:
    """Results that are not older than the time to live."""
    return results.where(F.unix_micros(as_of) - F.unix_micros("ts") <= ttl_us)


def expire_alerts(state: DataFrame, as_of: Column, ttl_us: int = 86_400_000_000) -> DataFrame:
    """Alerts kept: within the time after resolution, or after creation if unresolved."""
    since = F.coalesce("resolved_at", "created_at")
    return state.where(F.unix_micros(as_of) - F.unix_micros(since) <= ttl_us)


# ---------------------------------------------------------------- threshold rules


def default_rules(spark: SparkSession) -> DataFrame:
    """The shipped rules: a constant list, so its size is known and it may be broadcast."""
    return F.broadcast(spark.createDataFrame(ALERT_RULES, RULE_SCHEMA))


def match_alert_rules(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Samples joined to the rules of their metric, with ``breach``."""
    joined = samples.join(rules.withColumnRenamed("metric", "name"), "name")
    labels, matcher = F.col("labels"), F.col("matcher")
    selected = F.forall(F.map_keys(matcher), lambda k: F.coalesce(F.try_element_at(labels, k) == F.try_element_at(matcher, k), F.lit(False)))
    value, limit = F.col("value"), F.col("threshold")
    breach = (
        F.when(F.col("cmp") == ">", value > limit)
        .when(F.col("cmp") == "<", value < limit)
        .when(F.col("cmp") == ">=", value >= limit)
        .when(F.col("cmp") == "<=", value <= limit)
        .when(F.col("cmp") == "==", value == limit)
    )
    return joined.where(selected).withColumns({"breach": breach, "series": format_labels("labels")})


def breach_runs(matched: DataFrame, width: str = "1 hour", keys: Sequence[str] = ("rule", "series")) -> DataFrame:
    """Adds ``since`` (start of the unbroken run of breaches) and ``firing``.

    Runs are found inside time chunks. What a chunk needs from before is whether the run at its
    start goes on and since when: that follows from one row per earlier chunk.
    """
    keys = list(keys)
    breach, order = F.col("breach"), ["ts", "seq"]
    part = [*keys, "_chunk"]
    base = matched.withColumn("_chunk", time_chunk("ts", width))
    upto = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # the breach right after a row that is none starts a run
    start = F.when(breach & ~F.lag("breach").over(W.partitionBy(*part).orderBy(*order)), F.col("ts"))
    local = base.withColumn("_start", start).withColumns(
        {
            "_run": F.last("_start", ignorenulls=True).over(upto),
            "_head": F.min(breach).over(upto),
            "_first": F.min("ts").over(upto),
        }
    )
    at = F.struct(*order)
    chunks = local.groupBy(*part).agg(
        F.min("breach").alias("_all"), F.max_by("breach", at).alias("_last"), F.max_by("_run", at).alias("_tail"), F.min("ts").alias("_from")
    )
    by_time = W.partitionBy(*keys).orderBy("_chunk")
    before = by_time.rowsBetween(W.unboundedPreceding, -1)
    # where the run after a chunk with a pause starts: at its own tail, or with the next chunk
    chunks = chunks.withColumn("_after", F.when(~F.col("_all"), F.coalesce(F.when(F.col("_last"), F.col("_tail")), F.lead("_from").over(by_time))))
    origin = F.coalesce(F.last("_after", ignorenulls=True).over(before), F.first("_from").over(before))
    carry = chunks.select(*[F.col(c).alias(f"{c}_of") for c in part], F.when(F.lag("_last").over(by_time), origin).alias("_carry"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in part])
    carried = local.join(carry, same).drop(*[f"{c}_of" for c in part])
    since = F.when(breach, F.when(F.col("_head"), F.coalesce("_carry", "_first")).otherwise(F.col("_run")))
    held = F.unix_micros("ts") - F.unix_micros("since") >= F.col("hold_seconds") * 1_000_000
    out = carried.withColumn("since", since).withColumn("firing", F.coalesce(held, F.lit(False)))
    return out.drop("_chunk", "_start", "_run", "_head", "_first", "_carry")


def alert_for(samples: DataFrame, rules: DataFrame, width: str = "1 hour") -> DataFrame:
    """Samples at which a rule has held for its ``for`` time."""
    return breach_runs(match_alert_rules(samples, rules), width).where("firing")


def alert_episodes(samples: DataFrame, rules: DataFrame, width: str = "1 hour") -> DataFrame:
    """Pending, firing and resolved time of every run of breaches."""
    keys = ["rule", "series"]
    runs = breach_runs(match_alert_rules(samples, rules), width)
    stepped = previous(runs, keys, ["ts", "seq"], ["since"], time_chunk("ts", width), "_prev")
    ends = stepped.where(~F.col("breach") & F.col("_prev.since").isNotNull()).select(
        *keys, F.col("_prev.since").alias("since"), F.col("ts").alias("resolved_at")
    )
    episodes = (
        runs.where("breach")
        .groupBy(*keys, "since")
        .agg(F.min(F.when(F.col("firing"), F.col("ts"))).alias("fired_at"), F.count(F.lit(1)).alias("samples"))
    )
    return episodes.join(ends, [*keys, "since"], "left")


def notify(df: DataFrame, handlers: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Hand a frame to every handler; a failing handler does not stop the others.

    Returns the error text of each handler that failed.
    """
    errors = {}
    for name, handler in handlers.items():
        try:
            handler(df)
        except Exception as e:
            errors[name] = str(e)
    return errors
