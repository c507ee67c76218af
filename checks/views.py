"""The canonical tables once more as plain SQL, for the independent check engine."""

VIEWS = {
    "leaf": """
    SELECT d.scope, d.source, d.priority, d.loaded_seq, x.path, x.value, x.value_type FROM (
      SELECT o_custkey AS scope, 's' || CAST(o_orderkey % 3 AS VARCHAR) AS source, o_orderkey % 5 AS priority, o_orderkey AS loaded_seq FROM orders) d,
    LATERAL (SELECT unnest([
      {'path': 'name', 'value': 'web-' || CAST(loaded_seq % 17 AS VARCHAR), 'value_type': 'string'},
      {'path': CASE WHEN loaded_seq % 7 = 0 THEN 'server' ELSE 'server.host' END, 'value': CASE WHEN loaded_seq % 7 = 0 THEN 'down' ELSE 'host' || CAST(loaded_seq % 9 AS VARCHAR) END, 'value_type': 'string'},
      {'path': CASE WHEN loaded_seq % 7 <> 0 THEN 'server.port' END, 'value': CAST(loaded_seq % 70000 AS VARCHAR), 'value_type': 'int'},
      {'path': CASE WHEN loaded_seq % 7 <> 0 THEN 'server.ssl.enabled' END, 'value': CAST(loaded_seq % 2 = 0 AS VARCHAR), 'value_type': 'bool'},
      {'path': CASE WHEN loaded_seq % 7 <> 0 THEN 'db.password' END, 'value': 'pw' || CAST(loaded_seq % 5 AS VARCHAR), 'value_type': 'string'},
      {'path': CASE WHEN loaded_seq % 7 <> 0 THEN 'db.url' END, 'value': 'http://db' || CAST(loaded_seq % 4 AS VARCHAR) || '/${REGION}/${TIER:-basic}', 'value_type': 'string'},
      {'path': CASE WHEN loaded_seq % 7 <> 0 AND loaded_seq % 6 <> 0 THEN 'db.pool_size' END, 'value': CAST(scope % 20 AS VARCHAR), 'value_type': 'int'},
      {'path': CASE WHEN loaded_seq % 7 <> 0 THEN 'tags' END, 'value': '["' || CAST(loaded_seq % 3 AS VARCHAR) || '","x"]', 'value_type': 'list'}]) AS x) t
    WHERE x.path IS NOT NULL""",
    "merged": """
    SELECT l.scope, l.path, l.value, l.value_type, l.priority, l.loaded_seq FROM (
      SELECT *, row_number() OVER (PARTITION BY scope, path ORDER BY priority DESC, loaded_seq DESC) AS rn,
        max(CASE WHEN path = 'server' THEN priority * 1000000000 + loaded_seq END) OVER (PARTITION BY scope) AS flat_rank,
        max(CASE WHEN path LIKE 'server.%' THEN priority * 1000000000 + loaded_seq END) OVER (PARTITION BY scope) AS deep_rank
      FROM leaf) l
    WHERE rn = 1 AND NOT (path = 'server' AND coalesce(deep_rank, -1) > flat_rank)
      AND NOT (path LIKE 'server.%' AND coalesce(flat_rank, -1) > priority * 1000000000 + loaded_seq)""",
    "env": """
    SELECT c_custkey AS scope, x.name, x.value FROM customer, LATERAL (SELECT unnest([
      {'name': CASE WHEN c_custkey % 2 = 0 THEN 'REGION' END, 'value': 'r' || CAST(c_nationkey AS VARCHAR)},
      {'name': CASE WHEN c_custkey % 3 = 0 THEN 'TIER' END, 'value': lower(c_mktsegment)},
      {'name': 'APP_SERVER__PORT', 'value': CAST(c_custkey % 9000 AS VARCHAR)}, {'name': 'APP_SERVER__HOST', 'value': c_name},
      {'name': 'APP_DEBUG', 'value': CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END}]) AS x) t WHERE x.name IS NOT NULL""",
    "task": """
    SELECT o_orderkey AS task_id, o_custkey AS queue_id,
      (['perception_','reasoning_system1_','memory_'])[CAST(o_orderkey % 3 + 1 AS INT)] || CAST(o_orderkey AS VARCHAR) AS name,
      CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS priority5,
      ([100, 90, 80, 50, 20])[CAST(substr(o_orderpriority, 1, 1) AS INT)] AS priority7,
      CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status,
      epoch_us(o_orderdate) AS created_us,
      CASE WHEN o_orderkey % 7 <> 0 THEN epoch_us(o_orderdate) + o_orderkey % 60 * 86400000000 END AS deadline_us,
      epoch_us(o_orderdate) + o_orderkey % 45 * 86400000000 AS min_start_us,
      o_custkey % 900 + 100 AS max_duration_ms, CAST(o_orderkey % 1000 AS DOUBLE) AS max_latency_ms,
      o_orderkey % 5 = 0 AS is_hard_realtime, o_orderkey % 4 <> 0 AS is_preemptible,
      epoch_us(o_orderdate) + o_orderkey * 7919 % 1000 * 1000 AS scheduled_us,
      epoch_us(o_orderdate) + o_orderkey * 7919 % 1000 * 1000 + o_orderkey * 31 % 50 * 1000 AS started_us,
      CASE WHEN o_orderstatus = 'F' THEN epoch_us(o_orderdate) + o_orderkey * 7919 % 1000 * 1000
        + o_orderkey * 31 % 50 * 1000 + o_custkey * 131 % 6000 * 1000 END AS completed_us,
      o_custkey % 10 AS pool, o_orderkey // 10 AS batch_id,
      CASE WHEN o_orderkey % 3 = 0 THEN list_filter([o_orderkey - 1, o_orderkey - 2], lambda x: x >= 0) ELSE [] END AS depends_on,
      (['compute','io','memory','gpu'])[CAST(o_orderkey % 4 + 1 AS INT)] AS task_type,
      o_totalprice AS amount, o_orderkey AS seq
    FROM orders""",
    "latency": """
    SELECT * FROM (
      SELECT task_id, name, priority7, seq, 'scheduling' AS kind, (scheduled_us - created_us) / 1000.0::DOUBLE AS latency_ms, scheduled_us AS ts_us FROM task
      UNION ALL
      SELECT task_id, name, priority7, seq, 'execution', (completed_us - started_us) / 1000.0::DOUBLE, completed_us FROM task
      UNION ALL
      SELECT task_id, name, priority7, seq, 'total', (completed_us - created_us) / 1000.0::DOUBLE, completed_us FROM task
    ) WHERE latency_ms IS NOT NULL""",
    "task_event": """
    SELECT * FROM (
      SELECT task_id, queue_id, pool, priority5, priority7, created_us AS ts_us, task_id * 8 AS seq, 'pending' AS event FROM task
      UNION ALL SELECT task_id, queue_id, pool, priority5, priority7, scheduled_us, task_id * 8 + 1, 'ready' FROM task WHERE task_id % 13 <> 0
      UNION ALL SELECT task_id, queue_id, pool, priority5, priority7, started_us, task_id * 8 + 2, 'running' FROM task WHERE status <> 'pending'
      UNION ALL SELECT task_id, queue_id, pool, priority5, priority7, completed_us, task_id * 8 + 3,
        CASE WHEN task_id % 10 = 1 THEN 'failed' ELSE 'completed' END FROM task WHERE status = 'completed'
      UNION ALL SELECT task_id, queue_id, pool, priority5, priority7, created_us + 86400000000, task_id * 8 + 4, 'cancelled'
        FROM task WHERE status = 'pending' AND task_id % 11 = 0
      UNION ALL SELECT task_id, queue_id, pool, priority5, priority7, deadline_us, task_id * 8 + 5, 'deadline_missed'
        FROM task WHERE status = 'pending' AND deadline_us IS NOT NULL AND task_id % 17 = 0)""",
    "queue_event": """
    SELECT * FROM (
      SELECT queue_id, task_id, priority5, created_us AS ts_us, task_id * 4 AS seq, 'put' AS event FROM task
      UNION ALL SELECT queue_id, task_id, priority5, completed_us, task_id * 4 + 1, 'get' FROM task WHERE status = 'completed'
      UNION ALL SELECT queue_id, task_id, priority5, deadline_us, task_id * 4 + 2, 'expire' FROM task
        WHERE status = 'pending' AND deadline_us IS NOT NULL AND task_id % 2 = 0)""",
    "result": """
    SELECT l_orderkey AS task_id, l_suppkey AS worker_id, l_suppkey % 10 AS pool, epoch_us(l_shipdate) AS ts_us,
      (l_partkey * 10000000 + l_suppkey) * 10 + l_linenumber AS seq, l_quantity * 100 AS processing_ms,
      l_returnflag <> 'R' AS success,
      CASE WHEN l_returnflag = 'R' THEN 'worker ' || CAST(l_suppkey AS VARCHAR) || ' failed' END AS error
    FROM lineitem""",
    "metric": """
    SELECT event_type AS name, epoch_us(ts) AS ts_us, event_id AS seq, value, user_id, props FROM events""",
    "gauge_op": """
    SELECT user_id AS series, epoch_us(ts) AS ts_us, event_id AS seq,
      CASE WHEN event_type = 'signup' THEN 'set' ELSE 'increment' END AS op, value FROM events""",
    "health": """
    SELECT user_id AS host, CASE WHEN event_type = 'view' THEN 'memory' ELSE 'cpu' END AS "check", epoch_us(ts) AS ts_us,
      event_id AS seq, round(value % 100, 2) AS percent FROM events WHERE event_type IN ('view', 'click')""",
    "health_class": """
    SELECT *, CASE WHEN percent > 90 THEN 'unhealthy' WHEN "check" = 'memory' AND percent > 80 THEN 'degraded'
      WHEN "check" = 'cpu' AND percent > 70 THEN 'degraded' ELSE 'healthy' END AS status FROM health""",
    "alert_event": """
    SELECT event_id AS alert_id, (['info','warning','error','critical'])[CAST(event_id % 4 + 1 AS INT)] AS level,
      event_type AS source, epoch_us(ts) AS ts_us, 'create' AS op FROM events WHERE event_type IN ('error', 'purchase')
    UNION ALL
    SELECT event_id, (['info','warning','error','critical'])[CAST(event_id % 4 + 1 AS INT)],
      event_type, epoch_us(ts) + 3600000000, 'resolve' FROM events WHERE event_type IN ('error', 'purchase') AND event_id % 3 = 0""",
    "claim": """
    SELECT l_partkey AS resource, l_orderkey AS task_id, min(epoch_us(l_shipdate)) AS ts_us FROM lineitem GROUP BY 1, 2""",
    "hold": """
    SELECT resource, task_id FROM (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY ts_us, task_id) AS rn FROM claim) WHERE rn = 1""",
    "wait": """
    SELECT c.resource, c.task_id, c.ts_us FROM claim c JOIN hold h ON c.resource = h.resource WHERE c.task_id <> h.task_id""",
    "edge": """
    SELECT DISTINCT w.task_id AS waiter, h.task_id AS holder FROM wait w JOIN hold h ON w.resource = h.resource""",
    "pool": """
    SELECT (['compute','io','memory'])[CAST(s_suppkey % 3 + 1 AS INT)] AS task_type,
      CAST(min(s_nationkey % 5 + 1) AS BIGINT) AS min_workers, CAST(max(s_nationkey % 5 + 6) AS BIGINT) AS max_workers
    FROM supplier GROUP BY 1""",
    "pool_tick": """
    SELECT event_type AS task_type, epoch_us(date_trunc('hour', ts)) AS ts_us, count(*) AS queue_size,
      count(*) FILTER (WHERE user_id % 3 = 0) AS active_workers, CAST(10 AS BIGINT) AS total_workers
    FROM events GROUP BY 1, 2""",
    "memory_op": """
    SELECT user_id AS memory_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'store' ELSE 'retrieve' END AS op,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS key, value FROM events""",
}

# what each view reads from the other views
NEEDS = {
    "merged": ["leaf"],
    "latency": ["task"],
    "task_event": ["task"],
    "queue_event": ["task"],
    "health_class": ["health"],
    "hold": ["claim"],
    "wait": ["hold"],
    "edge": ["wait"],
}


def with_views(names: str, query: str, recursive: bool = False) -> str:
    """Put the named views (and what they need) in front of a query as common tables."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names.split():
        add(name)
    if not ordered:
        return query
    tables = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in ordered)
    body = query.strip()
    word = "WITH RECURSIVE" if recursive else "WITH"
    if body[:5].upper() == "WITH ":
        return f"{word} {tables},\n{body[5:]}"
    return f"{word} {tables}\n{body}"
