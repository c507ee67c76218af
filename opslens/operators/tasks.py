"""Task predicates, orders, dependency and result joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions.fixed import FEEDBACK_LEVEL, TIME_SLICES_MS, lookup
from opslens.plans.ordered import first_n, first_row, last_row, number_chunk, position, previous, time_chunk

# allowed moves are two words each; more than this many would be no constant list
BROADCAST_MOVES = 10_000

# ---------------------------------------------------------------- predicates


def validate_constraints(tasks: DataFrame) -> DataFrame:
    """Adds ``errors``: the broken constraint rules of each task, in rule order."""
    rules = F.array(
        F.when(F.col("min_start_time") >= F.col("deadline"), "min_start_time must be before deadline"),
        # a zero latency or duration counts as not given
        F.when(
            (F.col("max_latency_ms") != 0) & (F.col("max_duration_ms") != 0) & (F.col("max_latency_ms") > F.col("max_duration_ms")),
            "max_latency_ms exceeds max_duration",
        ),
        F.when(F.col("is_hard_realtime") & F.col("deadline").isNull(), "hard realtime tasks must have a deadline"),
    )
    return tasks.withColumn("errors", F.filter(rules, lambda e: e.isNotNull()))


def is_ready(as_of: Column) -> Column:
    """Pending and not before its earliest start."""
    return (F.col("status") == "pending") & F.coalesce(F.col("min_start_time") <= as_of, F.lit(True))


def deadline_approaching(threshold_ms: int, as_of: Column) -> Column:
    """At most ``threshold_ms`` left; a missed deadline counts too, no deadline never does."""
    left = F.unix_micros("deadline") - F.unix_micros(as_of)
    return F.coalesce(left <= threshold_ms * 1000, F.lit(False))


def missed_deadline(as_of: Column) -> Column:
    return F.coalesce(F.col("deadline") < as_of, F.lit(False))


def deadline_violations(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Tasks past their deadline that are not completed, with the hard real-time flag."""
    return tasks.where((F.col("status") != "completed") & missed_deadline(as_of)).withColumn(
        "is_hard_violation", F.col("is_hard_realtime")
    )


def urgent_tasks(tasks: DataFrame, as_of: Column, threshold_ms: int = 100) -> DataFrame:
    """Pending tasks whose deadline is near, to be served by earliest deadline."""
    return tasks.where((F.col("status") == "pending") & deadline_approaching(threshold_ms, as_of))


def earliest_urgent(tasks: DataFrame, keys: Sequence[str], as_of: Column, threshold_ms: int = 100) -> DataFrame:
    """The urgent task with the earliest deadline per key."""
    return first_row(urgent_tasks(tasks, as_of, threshold_ms), keys, F.struct("deadline", "seq"))


def split_expired(tasks: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Live and expired rows of a queue."""
    gone = F.coalesce(F.col("deadline") < as_of, F.lit(False))
    return tasks.where(~gone), tasks.where(gone)


def tasks_by_type(tasks: DataFrame, task_type: str) -> DataFrame:
    return tasks.where(F.col("task_type") == task_type)


def cancel_eligible(mode: str = "task") -> Column:
    """``mode='task'`` also allows blocked tasks; ``'scheduler'`` does not."""
    allowed = {"task": ["pending", "ready", "blocked"], "scheduler": ["pending", "ready"]}[mode]
    return F.col("status").isin(allowed)


def split_valid(tasks: DataFrame, rule: Column, id_column: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """Rows that pass the rule, and failed results for those that do not."""
    good = F.coalesce(rule, F.lit(False))
    rejected = tasks.where(~good).select(
        id_column, F.lit(False).alias("success"), F.lit("Task validation failed").alias("error")
    )
    return tasks.where(good), rejected


def initial_level(num_levels: int = 4, priority: str = "priority7") -> Column:
    """Feedback level of a new task, clamped to the levels there are."""
    level = F.coalesce(lookup(priority, FEEDBACK_LEVEL), F.lit(2))
    return F.greatest(F.lit(0), F.least(level, F.lit(num_levels - 1)))


def time_slice_ms(level: Column) -> Column:
    slices = F.array(*[F.lit(x) for x in TIME_SLICES_MS])
    return F.element_at(slices, F.least(level, F.lit(len(TIME_SLICES_MS) - 1)) + 1)


def route_latency_metric(name: str = "name") -> DataFrame | Column:
    """Metric and labels a task's execution time is recorded under; null when none."""
    col = F.col(name)
    system = F.when(col.contains("system1"), "1").otherwise("2")
    return F.when(
        col.startswith("perception"),
        F.struct(F.lit("perception_latency_ms").alias("metric"), F.create_map(F.lit("type"), F.lit("execution")).alias("labels")),
    ).when(
        col.startswith("reasoning"),
        F.struct(F.lit("reasoning_latency_ms").alias("metric"), F.create_map(F.lit("system"), system).alias("labels")),
    )


# ---------------------------------------------------------------- orders


def priority_order(tasks: DataFrame, keys: Sequence[str], width: int = 1_000_000, priority: str = "priority7") -> DataFrame:
    """``rank`` in the priority queue: priority descending, then arrival."""
    # chunks rise with nulls first, descending priorities end with nulls
    chunk = [F.col(priority).isNull().cast("int"), -F.col(priority), number_chunk("seq", width)]
    return position(tasks, keys, [F.col(priority).desc(), F.col("seq")], chunk, "rank")


def edf_order(tasks: DataFrame, keys: Sequence[str], as_of: Column, width: str = "1 hour") -> DataFrame:
    """``rank`` by earliest deadline (none last), with the late flag."""
    none = F.col("deadline").isNull()
    chunk = [none.cast("int"), F.coalesce(time_chunk("deadline", width), F.lit(0)), F.when(none, number_chunk("seq", 1_000_000)).otherwise(0)]
    ranked = position(tasks, keys, [F.col("deadline").asc_nulls_last(), F.col("seq")], chunk, "rank")
    return ranked.withColumn("deadline_missed", missed_deadline(as_of))


def task_order(tasks: DataFrame, keys: Sequence[str], width: str = "1 hour", priority: str = "priority7") -> DataFrame:
    """``rank`` by priority, then deadline (tasks with one first), then creation."""
    none = F.col("deadline").isNull()
    at = F.coalesce(F.col("deadline"), F.col("created_at"))
    chunk = [F.col(priority).isNull().cast("int"), -F.col(priority), none.cast("int"), time_chunk(at, width)]
    # two tasks with the same deadline are equal in the comparison: arrival decides
    tie = F.when(none, F.col("created_at"))
    order = [F.col(priority).desc(), F.col("deadline").asc_nulls_last(), tie, F.col("seq")]
    return position(tasks, keys, order, chunk, "rank")


def dispatch_order(tasks: DataFrame, keys: Sequence[str], width: str = "1 hour") -> DataFrame:
    """``rank`` of distributed tasks: five-level priority ascending, then creation."""
    chunk = [F.col("priority5"), time_chunk("created_at", width)]
    return position(tasks, keys, [F.col("priority5"), F.col("created_at"), F.col("seq")], chunk, "rank")


def fair_order(tasks: DataFrame, keys: Sequence[str], num_levels: int = 4, width: int = 1_000_000) -> DataFrame:
    """``rank`` in the feedback queue: level ascending, first come first served, slice attached."""
    leveled = tasks.withColumn("level", initial_level(num_levels))
    ranked = position(leveled, keys, [F.col("level"), F.col("seq")], [F.col("level"), number_chunk("seq", width)], "rank")
    return ranked.withColumn("slice_ms", time_slice_ms(F.col("level")))


def next_k(tasks: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The next k tasks of each queue; with no keys, of the whole table."""
    if not keys:
        return tasks.orderBy(*order).limit(k)
    return first_n(tasks, keys, order, k, rank="rank")


def all_in_order(tasks: DataFrame, order: Sequence[Column]) -> DataFrame:
    return tasks.orderBy(*order)


def latest_priority(updates: DataFrame) -> DataFrame:
    """Current priority per task after updates: the latest write wins."""
    return updates.groupBy("task_id").agg(F.max_by("priority5", "seq").alias("priority5"))


# ---------------------------------------------------------------- joins


def dependencies_satisfied(tasks: DataFrame) -> DataFrame:
    """Adds ``unmet`` and ``dependency_state``: blocked unless every dependency is completed."""
    done = tasks.where(F.col("status") == "completed").select(F.col("task_id").alias("dep"))
    needs = tasks.select("task_id", F.explode(F.array_distinct("depends_on")).alias("dep"))
    unmet = needs.join(done, "dep", "left_anti").groupBy("task_id").agg(F.count(F.lit(1)).alias("unmet"))
    return tasks.join(unmet, "task_id", "left").withColumns(
        {
            "unmet": F.coalesce("unmet", F.lit(0)),
            "dependency_state": F.when(F.coalesce("unmet", F.lit(0)) > 0, "blocked").otherwise("ready"),
        }
    )


def preemption_candidates(tasks: DataFrame, keys: Sequence[str], as_of: Column, rank: str = "priority7") -> DataFrame:
    """Pending tasks that may take the place of a running one in the same pool.

    Only hard real-time tasks of high priority ask for it. ``rank`` names the priority that counts
    between two tasks, for instance one raised by what waits for the task.

    The victim is the lowest-priority preemptible running task of the pool, so the join has
    one row per pool on its right side.
    """
    victims = first_row(
        tasks.where((F.col("status") == "running") & F.col("is_preemptible")).select(
            *keys,
            F.col("task_id").alias("victim_id"),
            F.col(rank).alias("victim_priority"),
            F.col("deadline").alias("victim_deadline"),
            F.col("seq").alias("victim_seq"),
        ),
        keys,
        F.struct("victim_priority", "victim_seq"),
    )
    new = tasks.where((F.col("status") == "pending") & (F.col("priority7") >= 80) & F.col("is_hard_realtime"))
    ours = F.unix_micros("deadline") - F.unix_micros(as_of)
    theirs = F.unix_micros("victim_deadline") - F.unix_micros(as_of)
    worth_it = (F.col("priority7") == 100) | F.coalesce(ours < theirs * 0.8, F.lit(True))
    return (
        new.join(victims, list(keys))
        .where((F.col(rank) > F.col("victim_priority")) & worth_it)
        .select(*keys, "task_id", "priority7", "victim_id", "victim_priority")
    )


def route_to_pool(tasks: DataFrame, pools: DataFrame) -> DataFrame:
    return tasks.join(pools, "task_type")


def unroutable(tasks: DataFrame, pools: DataFrame) -> DataFrame:
    missing = tasks.join(pools.select("task_type"), "task_type", "left_anti")
    return missing.withColumn("error", F.concat(F.lit("No worker pool for task type: "), F.col("task_type")))


def final_results(results: DataFrame) -> DataFrame:
    """The last attempt of each task."""
    return last_row(results, ["task_id"], F.struct("ts", "seq"))


def task_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Each task with its final result, or nulls."""
    final = final_results(results).select("task_id", "worker_id", "success", "error", "processing_ms", F.col("ts").alias("result_ts"))
    return tasks.join(final, "task_id", "left")


def pending_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    return tasks.join(results.select("task_id"), "task_id", "left_anti")


def batch_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Results of the batches in which every member has one, a row per member."""
    final = final_results(results).select("task_id", "success", "error", "processing_ms")
    members = tasks.select("batch_id", "task_id").join(final, "task_id", "left")
    state = members.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count("success").alias("n_results")
    )
    complete = state.where(F.col("n_tasks") == F.col("n_results")).drop("n_results")
    return members.join(complete, "batch_id")


# ---------------------------------------------------------------- attempts


def retry_chain(attempts: DataFrame, tasks: DataFrame, max_retries: int = 3, width: str = "1 hour") -> DataFrame:
    """Attempt number, lowered priority and outcome of every attempt up to the retry limit.

    An attempt belongs to the chain while all earlier ones failed and retries are left.
    """
    numbered = position(attempts, ["task_id"], [F.col("ts"), F.col("seq")], time_chunk("ts", width), "attempt")
    # an attempt counts if no earlier one succeeded and the limit is not used up
    firsts = attempts.where("success").groupBy("task_id").agg(F.min(F.struct("ts", "seq")).alias("_ok"))
    chain = (
        numbered.where(F.col("attempt") <= max_retries + 1)
        .join(firsts, "task_id", "left")
        .where(F.col("_ok").isNull() | (F.struct("ts", "seq") <= F.col("_ok")))
        .drop("_ok")
    )
    last = F.col("success") | (F.col("attempt") == max_retries + 1)
    return chain.join(tasks.select("task_id", "priority5"), "task_id").select(
        "task_id",
        "attempt",
        F.least(F.col("priority5") + F.col("attempt") - 1, F.lit(4)).cast("int").alias("priority5"),
        "worker_id",
        "processing_ms",
        "success",
        F.when(F.col("success"), "completed").when(last, "failed").otherwise("retried").alias("outcome"),
        F.when(~F.col("success"), F.col("error")).alias("error"),
    )


def lifecycle_check(events: DataFrame, moves: DataFrame, width: str = "1 hour") -> DataFrame:
    """Status moves that the transition table does not allow."""
    stepped = previous(events, ["task_id"], ["ts", "seq"], ["event"], time_chunk("ts", width), "_prev")
    moved = stepped.where(F.col("_prev").isNotNull()).withColumns({"from_status": F.col("_prev.event"), "to_status": F.col("event")})
    return moved.drop("_prev").join(moves, ["from_status", "to_status"], "left_anti")


def transition_table(spark, moves) -> DataFrame:
    """Table of allowed moves; up to ``BROADCAST_MOVES`` of them are broadcast."""
    moves = list(moves)
    table = spark.createDataFrame(moves, "from_status string, to_status string")
    return F.broadcast(table) if len(moves) <= BROADCAST_MOVES else table
