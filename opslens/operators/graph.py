"""Wait-for graph: edges, deadlocks, priority inheritance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslens.session import cut_lineage


def wait_for_edges(holds: DataFrame, waits: DataFrame) -> DataFrame:
    """Distinct edges ``waiter -> holder``. A resource has one holder, so there are no more
    edges than waits; a task never waits for itself."""
    held = holds.select("resource", F.col("task_id").alias("holder"))
    wanted = waits.select("resource", F.col("task_id").alias("waiter"))
    return wanted.join(held, "resource").where(F.col("waiter") != F.col("holder")).select("waiter", "holder").distinct()


def _trim(edges: DataFrame, rounds: int) -> DataFrame:
    """Drop edges whose waiter nobody waits for or whose holder waits for nobody."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("holder").alias("waiter")).distinct(), "waiter", "left_semi")
        edges = edges.join(edges.select(F.col("waiter").alias("holder")).distinct(), "holder", "left_semi")
    return edges.select("waiter", "holder")


def _links(edges: DataFrame) -> DataFrame:
    """Ways a label travels: ahead along an edge, back along it, and to the node itself. One
    frame, so that a round reads the labels once. Not partitioned by node: a task that a third
    of all others wait for would fill one partition that no later join could split."""
    ways = F.array(
        F.struct(F.col("waiter").alias("node"), F.col("holder").alias("to"), F.lit("ahead").alias("way")),
        F.struct(F.col("holder").alias("node"), F.col("waiter").alias("to"), F.lit("back").alias("way")),
        F.struct(F.col("waiter").alias("node"), F.col("waiter").alias("to"), F.lit("self").alias("way")),
        F.struct(F.col("holder").alias("node"), F.col("holder").alias("to"), F.lit("self").alias("way")),
    )
    return cut_lineage(edges.select(F.inline(ways)).distinct())


def _spread(labels: DataFrame, links: DataFrame) -> DataFrame:
    """One round: each node takes the smallest forward and backward label of its neighbours."""
    return (
        links.join(labels, "node")
        .groupBy(F.col("to").alias("node"))
        .agg(
            F.expr("min(fwd) FILTER (WHERE way <> 'back')").alias("fwd"),
            F.expr("min(bwd) FILTER (WHERE way <> 'ahead')").alias("bwd"),
            F.expr("max(fwd) FILTER (WHERE way = 'self')").alias("_f"),
            F.expr("max(bwd) FILTER (WHERE way = 'self')").alias("_b"),
        )
        .select("node", "fwd", "bwd", ((F.col("fwd") != F.col("_f")) | (F.col("bwd") != F.col("_b"))).alias("changed"))
    )


def deadlocked_tasks(edges: DataFrame, steps_per_cut: int = 4) -> DataFrame:
    """Every task on a cycle with the smallest task id of its component.

    Repeated passes of two label propagations: ``fwd`` is the smallest id that reaches a node,
    ``bwd`` the smallest id it reaches. Nodes where both agree form a component with that id.
    The rest goes on with the edges whose two ends have equal label pairs. Each pass settles
    at least the node with the smallest id, so the loop always ends; lineage is cut by a
    reliable checkpoint every few rounds.
    """
    edges = cut_lineage(edges.select("waiter", "holder"))
    edges = cut_lineage(_trim(edges, 2))
    found = None
    while not edges.isEmpty():
        links = _links(edges)
        labels = links.where("way = 'self'").select("node", F.col("node").alias("fwd"), F.col("node").alias("bwd"))
        while True:
            for _ in range(steps_per_cut):
                labels = _spread(labels.select("node", "fwd", "bwd"), links)
            labels = cut_lineage(labels)
            if labels.where("changed").isEmpty():
                break
        settled = labels.where(F.col("fwd") == F.col("bwd")).select(F.col("node").alias("task_id"), F.col("fwd").alias("component"))
        sizes = settled.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
        cycles = settled.join(sizes.where(F.col("_n") > 1), "component").select("task_id", "component")
        found = cycles if found is None else found.unionByName(cycles)
        rest = labels.where(F.col("fwd") != F.col("bwd")).select("node", F.struct("fwd", "bwd").alias("pair"))
        a = rest.select(F.col("node").alias("waiter"), F.col("pair").alias("_a"))
        b = rest.select(F.col("node").alias("holder"), F.col("pair").alias("_b"))
        inside = edges.join(a, "waiter").join(b, "holder").where(F.col("_a") == F.col("_b")).select("waiter", "holder")
        edges = cut_lineage(_trim(inside, 1))
    if found is None:
        return edges.select(F.col("waiter").alias("task_id"), F.col("holder").alias("component"))
    return found


def inherited_priority(
    tasks: DataFrame, edges: DataFrame, transitive: bool = False, priority: str = "priority7", steps_per_cut: int = 3
) -> DataFrame:
    """Effective priority: the highest of a task's own and its waiters' priorities.

    ``transitive=True`` follows chains of waiters to a fixpoint.
    """
    current = tasks.select("task_id", F.col(priority).alias("own"), F.col(priority).alias("effective"))

    def once(now: DataFrame) -> DataFrame:
        donors = now.select(F.col("task_id").alias("waiter"), F.col("effective").alias("_p"))
        best = edges.join(donors, "waiter").groupBy(F.col("holder").alias("task_id")).agg(F.max("_p").alias("_p"))
        return now.join(best, "task_id", "left").select(
            "task_id",
            "own",
            F.greatest("effective", F.coalesce("_p", "effective")).alias("effective"),
            (F.coalesce("_p", "effective") > F.col("effective")).alias("changed"),
        )

    if not transitive:
        return once(current).select("task_id", "own", "effective", (F.col("effective") > F.col("own")).alias("boosted"))
    edges = cut_lineage(edges)
    while True:
        for _ in range(steps_per_cut):
            current = once(current)
        current = cut_lineage(current)
        if current.where("changed").isEmpty():
            break
    return current.select("task_id", "own", "effective", (F.col("effective") > F.col("own")).alias("boosted"))


def priority_inversions(holds: DataFrame, waits: DataFrame, tasks: DataFrame, priority: str = "priority7") -> DataFrame:
    """Waiters that outrank the holder of a resource."""
    ranked = tasks.select("task_id", F.col(priority).alias("_p"))
    held = holds.join(ranked, "task_id").select("resource", F.col("task_id").alias("low_task"), F.col("_p").alias("low_priority"))
    wanted = waits.join(ranked, "task_id").select("resource", F.col("task_id").alias("high_task"), F.col("_p").alias("high_priority"))
    out = wanted.join(held, "resource").where(F.col("high_priority") > F.col("low_priority"))
    return out.select("high_task", "low_task", "resource", "high_priority", "low_priority")


def blocked_on(waits: DataFrame, resource) -> DataFrame:
    """Tasks waiting for one resource."""
    return waits.where(F.col("resource") == F.lit(resource))


def next_waiter(waits: DataFrame, effective: DataFrame) -> DataFrame:
    """The waiter that gets each resource next: highest effective priority, then earliest."""
    ranked = waits.join(effective.select("task_id", "effective"), "task_id")
    first = F.struct(-F.col("effective"), "ts", "task_id")
    return ranked.groupBy("resource").agg(F.min_by(F.struct("task_id", "effective"), first).alias("_n")).select(
        "resource", F.col("_n.task_id").alias("task_id"), F.col("_n.effective").alias("effective")
    )


def free_after_release(holds: DataFrame, waits: DataFrame, released: DataFrame) -> DataFrame:
    """Resources of the released tasks that nobody waits for."""
    mine = holds.join(released.select("task_id"), "task_id", "left_semi")
    return mine.join(waits.select("resource").distinct(), "resource", "left_anti").select("resource", "task_id")


def acquire_all(requests: DataFrame, holds: DataFrame) -> DataFrame:
    """All or nothing: a request with any resource held by another task is blocked.

    Judged against the snapshot; requests do not compete with each other.
    """
    held = holds.select("resource", F.col("task_id").alias("_holder"))
    busy = F.col("_holder").isNotNull() & (F.col("_holder") != F.col("task_id"))
    return (
        requests.join(held, "resource", "left")
        .groupBy("task_id")
        .agg(F.count(F.lit(1)).alias("requested"), F.count_if(busy).alias("busy"))
        .withColumn("granted", F.col("busy") == 0)
    )
