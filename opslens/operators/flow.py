"""Counts, depths, utilisation and folds over queue and task event logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opslens.plans.folds import Fold, chunked_fold, folded_keys
from opslens.plans.ordered import first_row, last_row, running_sum, time_chunk

# ---------------------------------------------------------------- aggregates


def scheduling_summary(events: DataFrame, since: Column, as_of: Column) -> DataFrame:
    """Totals and per-priority counts, throughput per second and success percent.

    ``priority7`` is null on the total row.
    """

    def n(event: str, name: str) -> Column:
        return F.count_if(F.col("event") == event).alias(name)

    uptime = (F.unix_micros(as_of) - F.unix_micros(since)) / 1_000_000
    counted = events.rollup("priority7").agg(
        n("pending", "submitted"),
        n("completed", "completed"),
        n("failed", "failed"),
        n("cancelled", "cancelled"),
        n("deadline_missed", "deadline_missed"),
        n("inversion", "inversions"),
        n("preempted", "preemptions"),
    )
    return counted.withColumns(
        {
            "throughput_per_second": F.coalesce(F.try_divide(F.col("completed"), uptime), F.lit(0.0)),
            "success_pct": F.coalesce(F.try_divide(F.col("completed") * 100, F.col("submitted")), F.lit(0.0)),
        }
    )


def queue_stats(events: DataFrame, keys: Sequence[str] = ("queue_id",)) -> DataFrame:
    """Size, counts per kind of event and the priorities now queued, per queue."""
    keys = list(keys)
    step = F.when(F.col("event") == "put", 1).when(F.col("event").isin("get", "expire", "remove"), -1).otherwise(0)

    def n(event: str, name: str) -> Column:
        return F.count_if(F.col("event") == event).alias(name)

    by_priority = events.groupBy(*keys, "priority5").agg(
        F.sum(step).alias("size"), n("put", "enqueued"), n("get", "dequeued"), n("reject", "rejected"), n("expire", "expired")
    )
    entry = F.when(F.col("size") > 0, F.struct("priority5", "size"))
    return by_priority.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("size", "enqueued", "dequeued", "rejected", "expired")],
        # one entry per priority level
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("distribution"),
    )


def coordinator_stats(chain: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Submitted, completed, failed and retried tasks and the time successes took."""
    done = F.col("outcome") == "completed"
    return chain.groupBy(*keys).agg(
        F.count_if(F.col("attempt") == 1).alias("submitted"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "retried").alias("retried"),
        F.coalesce(F.sum(F.when(done, F.col("processing_ms"))), F.lit(0.0)).alias("total_processing_ms"),
        F.count_if(F.col("outcome") != "retried").alias("results_held"),
    )


def worker_stats(results: DataFrame, keys: Sequence[str] = ("pool", "worker_id")) -> DataFrame:
    """Per worker: completed, failed, time of successes and mean, first start, last success, last outcome."""
    ok = F.col("success")
    spent = F.coalesce(F.sum(F.when(ok, F.col("processing_ms"))), F.lit(0.0))
    return results.groupBy(*keys).agg(
        F.count_if(ok).alias("completed"),
        F.count_if(~ok).alias("failed"),
        spent.alias("total_processing_ms"),
        F.coalesce(F.try_divide(spent, F.count_if(ok)), F.lit(0.0)).alias("mean_processing_ms"),
        F.min("ts").alias("first_task_at"),
        F.max(F.when(ok, F.col("ts"))).alias("last_task_at"),
        F.max_by(F.when(ok, "completed").otherwise("failed"), F.struct("ts", "seq")).alias("last_outcome"),
    )


def pool_stats(results: DataFrame) -> DataFrame:
    """Worker totals rolled up: a row per worker, per pool and one for all."""
    per_worker = worker_stats(results)
    rolled = per_worker.rollup("pool", "worker_id").agg(
        F.sum("completed").alias("completed"),
        F.sum("failed").alias("failed"),
        F.sum("total_processing_ms").alias("total_processing_ms"),
        F.count(F.lit(1)).alias("workers"),
        F.count_if(F.col("last_outcome") == "completed").alias("workers_well"),
    )
    return rolled.withColumn(
        "mean_processing_ms", F.coalesce(F.try_divide(F.col("total_processing_ms"), F.col("completed")), F.lit(0.0))
    )


def resource_wait_stats(waits: DataFrame, as_of: Column) -> DataFrame:
    """Waiters per resource with mean and longest waiting time in ms."""
    waited = (F.unix_micros(as_of) - F.unix_micros("ts")) / 1000
    return waits.groupBy("resource").agg(
        F.count(F.lit(1)).alias("waiters"), F.avg(waited).alias("mean_wait_ms"), F.max(waited).alias("max_wait_ms")
    )


def level_sizes(tasks: DataFrame, keys: Sequence[str], num_levels: int = 4) -> DataFrame:
    """Tasks per feedback level, zeros included."""
    counts = tasks.groupBy(*keys).agg(*[F.count_if(F.col("level") == i).alias(f"_l{i}") for i in range(num_levels)])
    rows = F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"_l{i}").alias("size")) for i in range(num_levels)])
    return counts.select(*keys, F.inline(rows))


# ---------------------------------------------------------------- over time


def queue_depth(events: DataFrame, keys: Sequence[str] = ("queue_id",), width: str = "1 hour") -> DataFrame:
    """Queue size after every event."""
    step = F.when(F.col("event") == "put", 1).when(F.col("event").isin("get", "expire", "remove"), -1).otherwise(0)
    return running_sum(events, keys, ["ts", "seq"], step.cast("bigint"), time_chunk("ts", width), "depth")


def active_over_time(results: DataFrame, total_workers: int, keys: Sequence[str] = (), width: str = "1 hour") -> DataFrame:
    """Active attempts after every start or end, with utilisation percent.

    Starts and ends at the same instant are summed before anything is ordered.
    """
    end = F.timestamp_micros(F.unix_micros("ts") + (F.col("processing_ms") * 1000).cast("bigint"))
    marks = F.array(
        F.struct(F.col("ts").alias("at"), F.lit(1).cast("bigint").alias("step")),
        F.struct(end.alias("at"), F.lit(-1).cast("bigint").alias("step")),
    )
    steps = results.select(*keys, F.inline(marks)).groupBy(*keys, "at").agg(F.sum("step").alias("step"))
    swept = running_sum(steps, keys, ["at"], F.col("step"), time_chunk("at", width), "active")
    return swept.withColumn("utilization_pct", F.coalesce(F.try_divide(F.col("active") * 100, F.lit(total_workers)), F.lit(0.0)))


def scaling_decision(ticks: DataFrame, pools: DataFrame | None = None, rule: str = "coordinator") -> DataFrame:
    """Adds ``change`` (+1, 0, -1) and ``target`` within the limits of the pool.

    ``ticks`` carry ``min_workers`` and ``max_workers``, or ``pools`` supplies them.
    """
    df = ticks.join(pools, "task_type") if pools is not None else ticks
    queue, active = F.col("queue_size"), F.col("active_workers")
    if rule == "coordinator":
        change = F.when((queue > 5 * active) & (active < F.col("max_workers")), 1).when(
            (queue == 0) & (active > F.col("min_workers")), -1
        )
    elif rule == "adaptive":
        load = F.try_divide(queue, active)
        change = F.when(load > 0.8, 1).when(load < 0.2, -1)
    else:
        raise ValueError(f"unknown rule {rule}")
    df = df.withColumn("change", F.coalesce(change, F.lit(0)))
    return df.withColumn("target", F.greatest("min_workers", F.least("max_workers", active + F.col("change"))))


# ---------------------------------------------------------------- sets


def dedupe_enqueue(events: DataFrame, key: str = "task_id", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The first enqueue of every id; later ones are ignored."""
    return first_row(events, [key], F.struct(*order))


def still_queued(events: DataFrame, cleared: DataFrame | None = None) -> DataFrame:
    """Last row of every (queue, task) whose last event is a put; a retry puts the same task again.

    ``cleared`` has ``queue_id, clear_seq`` per cleared queue: what was put before that is gone too.
    """
    live = last_row(events, ["queue_id", "task_id"], F.struct("ts", "seq")).where(F.col("event") == "put")
    if cleared is None:
        return live
    last = cleared.groupBy("queue_id").agg(F.max("clear_seq").alias("clear_seq"))
    kept = live.join(last, "queue_id", "left").where(F.col("clear_seq").isNull() | (F.col("seq") > F.col("clear_seq")))
    return kept.drop("clear_seq")


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Several logs side by side, with the name of the source kept."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("source_name", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- folds


class BoundedQueue(Fold):
    """Depth of a queue that rejects a put when full.

    A run of events maps the depth before it to ``min(max(depth + a, lo), hi)``; such maps
    compose, so a run is summarised by the three numbers.
    """

    columns = ("event",)
    outputs = "accepted boolean, depth bigint"

    def __init__(self, max_size: int):
        self.max_size = max_size

    def empty(self):
        return 0, 0, self.max_size

    def absorb(self, summary, row):
        a, lo, hi = summary
        if row[0] == "put":
            return a + 1, min(lo + 1, self.max_size), min(hi + 1, self.max_size)
        return a - 1, max(lo - 1, 0), max(hi - 1, 0)

    def dump(self, summary):
        return " ".join(map(str, summary))

    def first_state(self):
        return "0"

    def advance(self, state, summary):
        a, lo, hi = map(int, summary.split())
        return str(min(max(int(state) + a, lo), hi))

    def load(self, state):
        return int(state)

    def step(self, depth, row):
        put = row[0] == "put"
        accepted = depth < self.max_size if put else depth > 0
        depth += (1 if put else -1) if accepted else 0
        return depth, (accepted, depth)


def admit(events: DataFrame, max_size: int, keys: Sequence[str] = ("queue_id",), width: str = "1 hour") -> DataFrame:
    """Replay of a bounded queue: a put on a full queue is rejected and adds no depth."""
    narrow = events.select(*keys, "ts", "seq", "event")
    return chunked_fold(narrow, keys, ["ts", "seq"], time_chunk("ts", width), BoundedQueue(max_size))


class ClampedMoves(Fold):
    """Composition of clamped steps: level -> ``min(max(level + a, lo), hi)``."""

    columns = ("move",)

    def __init__(self, top: int):
        self.top = top

    def empty(self):
        return 0, 0, self.top

    def absorb(self, summary, row):
        a, lo, hi = summary
        return a + row[0], min(max(lo + row[0], 0), self.top), min(max(hi + row[0], 0), self.top)

    def dump(self, summary):
        return " ".join(map(str, summary))

    def first_state(self):
        return self.dump(self.empty())

    def advance(self, state, summary):
        a, lo, hi = map(int, state.split())
        b, low, high = map(int, summary.split())
        return self.dump((a + b, min(max(lo + b, low), high), min(max(hi + b, low), high)))


def apply_level_moves(
    start: DataFrame, moves: DataFrame, num_levels: int = 4, key: str = "task_id", width: str = "1 hour"
) -> DataFrame:
    """Final feedback level after a sequence of demotions (+1) and promotions (-1).

    ``start`` has ``(key, level)``, ``moves`` has ``(key, ts, seq, move)``. Every step is clamped
    to the levels there are.
    """
    folded = folded_keys(moves.select(key, "ts", "seq", "move"), [key], ["ts", "seq"], time_chunk("ts", width), ClampedMoves(num_levels - 1))
    joined = start.select(key, F.col("level").cast("bigint").alias("level")).join(folded, key, "left")
    steps = F.transform(F.split("state", " "), lambda x: x.cast("bigint"))
    moved = F.greatest(steps[1], F.least(steps[2], F.col("level") + steps[0]))
    return joined.select(key, "level", F.when(F.col("state").isNull(), F.col("level")).otherwise(moved).alias("final_level"))
