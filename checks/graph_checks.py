"""Wait-for graph."""

from pyspark.sql import functions as F

from checks.registry import check, us
from opslens.operators import graph as ops
from opslens.sources import tables


def hold_wait(spark, d):
    claims = tables.resource_claim(spark, d)
    return tables.resource_hold(claims), tables.resource_wait(claims)


@check("wait_for_edges", "edge", "SELECT waiter, holder FROM edge")
def _(spark, d):
    return ops.wait_for_edges(*hold_wait(spark, d))


@check(
    "deadlocked_tasks",
    "edge",
    """WITH core AS (SELECT DISTINCT waiter, holder FROM edge WHERE waiter IN (SELECT holder FROM edge)),
    reach AS (SELECT waiter AS a, holder AS b FROM core UNION SELECT r.a, c.holder FROM reach r JOIN core c ON r.b = c.waiter)
    SELECT x.a AS task_id, min(least(x.a, x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1""",
    recursive=True,
)
def _(spark, d):
    return ops.deadlocked_tasks(ops.wait_for_edges(*hold_wait(spark, d)))


INHERIT_SQL = """best AS (SELECT e.holder, max(t.priority7) AS p FROM edge e JOIN task t ON t.task_id = e.waiter GROUP BY 1),
eff AS (SELECT t.task_id, t.priority7 AS own, greatest(t.priority7, coalesce(b.p, 0)) AS effective FROM task t LEFT JOIN best b ON b.holder = t.task_id)"""


@check("inherited_priority", "edge task", f"WITH {INHERIT_SQL} SELECT *, effective > own AS boosted FROM eff")
def _(spark, d):
    return ops.inherited_priority(tables.task(spark, d), ops.wait_for_edges(*hold_wait(spark, d)))


@check(
    "inherited_priority_transitive",
    "edge task",
    """WITH up AS (SELECT task_id AS node, priority7 AS p FROM task UNION SELECT e.holder, u.p FROM up u JOIN edge e ON e.waiter = u.node)
    SELECT t.task_id, t.priority7 AS own, max(u.p) AS effective, max(u.p) > t.priority7 AS boosted FROM task t JOIN up u ON u.node = t.task_id GROUP BY 1, 2""",
    recursive=True,
)
def _(spark, d):
    return ops.inherited_priority(tables.task(spark, d), ops.wait_for_edges(*hold_wait(spark, d)), transitive=True)


@check(
    "priority_inversions",
    "hold wait task",
    """SELECT w.task_id AS high_task, h.task_id AS low_task, w.resource, a.priority7 AS high_priority, b.priority7 AS low_priority
    FROM wait w JOIN hold h ON w.resource = h.resource JOIN task a ON a.task_id = w.task_id JOIN task b ON b.task_id = h.task_id WHERE a.priority7 > b.priority7""",
)
def _(spark, d):
    return ops.priority_inversions(*hold_wait(spark, d), tables.task(spark, d))


@check("blocked_on", "wait", "SELECT resource, task_id, ts_us FROM wait WHERE resource = 7")
def _(spark, d):
    return ops.blocked_on(hold_wait(spark, d)[1], 7).select("resource", "task_id", us("ts"))


@check(
    "next_waiter",
    "edge task",
    f"""WITH {INHERIT_SQL} SELECT resource, task_id, effective FROM (SELECT w.resource, w.task_id, e.effective,
    row_number() OVER (PARTITION BY w.resource ORDER BY e.effective DESC, w.ts_us, w.task_id) AS rn FROM wait w JOIN eff e ON e.task_id = w.task_id) WHERE rn = 1""",
)
def _(spark, d):
    holds, waits = hold_wait(spark, d)
    effective = ops.inherited_priority(tables.task(spark, d), ops.wait_for_edges(holds, waits))
    return ops.next_waiter(waits, effective)


@check(
    "free_after_release",
    "hold wait task",
    """SELECT h.resource, h.task_id FROM hold h JOIN task t ON t.task_id = h.task_id WHERE t.status <> 'pending'
    AND h.resource NOT IN (SELECT resource FROM wait WHERE resource % 2 = 0)""",
)
def _(spark, d):
    holds, waits = hold_wait(spark, d)
    released = tables.task(spark, d).where(F.col("status") != "pending")
    return ops.free_after_release(holds, waits.where(F.col("resource") % 2 == 0), released)


@check(
    "acquire_all",
    "hold claim",
    """SELECT c.task_id, count(*) AS requested, count(*) FILTER (WHERE h.task_id <> c.task_id) AS busy, count(*) FILTER (WHERE h.task_id <> c.task_id) = 0 AS granted
    FROM claim c LEFT JOIN (SELECT * FROM hold WHERE resource % 5 = 0) h ON h.resource = c.resource GROUP BY 1""",
)
def _(spark, d):
    claims = tables.resource_claim(spark, d)
    holds = tables.resource_hold(claims).where(F.col("resource") % 5 == 0)
    return ops.acquire_all(claims.select("resource", "task_id").distinct(), holds)
