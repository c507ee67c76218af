"""Canonical operations tables as views over a folder of Parquet tables.

Each function reads only the columns it names; timestamps become ``TIMESTAMP`` (session zone
UTC). Derived columns are plain expressions, so filters on them reach the scan as far as
Spark can push them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DAY_US = 86_400_000_000
STREAM = "stream!"
PARTS = "parts!"

TABLE_NAMES = (
    "task",
    "task_event",
    "queue_event",
    "result",
    "metric",
    "gauge_op",
    "health",
    "alert_event",
    "resource_claim",
    "pool",
    "pool_tick",
    "memory_op",
    "log_line",
    "config_doc",
)


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if folder.startswith(STREAM):
        from opslens.streaming.jobs import read_stream

        return read_stream(spark, folder.removeprefix(STREAM), f"{name}.parquet")
    if folder.startswith(PARTS):
        from opslens.streaming.jobs import read_stream

        files, place = folder.removeprefix(PARTS).split("!", 1)
        path = f"{place}/{name}.parquet"
        return read_stream(spark, path, "*.parquet", int(files), spark.read.parquet(path).schema)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_stream(folder: str) -> str:
    """The same folder, read as a stream by the row-wise views."""
    return STREAM + folder


def as_parts(folder: str, files: int = 1) -> str:
    """A folder whose tables are folders of files, read as a stream of so many files at a time, oldest first."""
    return f"{PARTS}{files}!{folder}"


def shift(ts: Column, micros: Column) -> Column:
    """Timestamp moved by a whole number of microseconds."""
    return F.timestamp_micros(F.unix_micros(ts) + micros.cast("bigint"))


def task(spark: SparkSession, folder: str) -> DataFrame:
    """One row per task with constraints, measured times and dependencies."""
    raw = _read(spark, folder, "orders").selectExpr(
        "o_orderkey AS k", "o_custkey AS c", "o_orderstatus AS s", "timestamp(o_orderdate) AS at",
        "int(substring(o_orderpriority, 1, 1)) - 1 AS p", "o_totalprice AS amount",
    )
    scheduled = "k * 7919 % 1000 * 1000"
    started = f"{scheduled} + k * 31 % 50 * 1000"
    completed = f"{started} + c * 131 % 6000 * 1000"

    def later(micros: str) -> str:
        return f"timestamp_micros(unix_micros(at) + {micros})"

    return raw.selectExpr(
        "k AS task_id",
        "c AS queue_id",
        "concat(element_at(array('perception_', 'reasoning_system1_', 'memory_'), int(k % 3 + 1)), string(k)) AS name",
        "p AS priority5",
        # fixed values: five-level to seven-level priority
        "element_at(array(100, 90, 80, 50, 20), p + 1) AS priority7",
        "CASE s WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'running' END AS status",
        "at AS created_at",
        f"CASE WHEN k % 7 <> 0 THEN {later(f'k % 60 * {DAY_US}')} END AS deadline",
        f"{later(f'k % 45 * {DAY_US}')} AS min_start_time",
        "c % 900 + 100 AS max_duration_ms",
        "double(k % 1000) AS max_latency_ms",
        "k % 5 = 0 AS is_hard_realtime",
        "k % 4 <> 0 AS is_preemptible",
        f"{later(scheduled)} AS scheduled_at",
        f"{later(started)} AS started_at",
        f"CASE WHEN s = 'F' THEN {later(completed)} END AS completed_at",
        "c % 10 AS pool",
        "k div 10 AS batch_id",
        "CASE WHEN k % 3 = 0 THEN filter(array(k - 1, k - 2), x -> x >= 0) ELSE cast(array() AS array<bigint>) END AS depends_on",
        "element_at(array('compute', 'io', 'memory', 'gpu'), int(k % 4 + 1)) AS task_type",
        "amount",
        "k AS seq",
    )


def task_event(spark: SparkSession, folder: str) -> DataFrame:
    """Status moves: one scan of the task table, up to six rows per task, no join."""
    t = task(spark, folder)
    key = F.col("task_id")
    ran = F.col("status") != "pending"

    def step(n: int, when: Column, ts: Column, event: Column) -> Column:
        return F.when(when, F.struct(ts.alias("ts"), (key * 8 + n).alias("seq"), event.alias("event")))

    steps = F.array(
        step(0, F.lit(True), F.col("created_at"), F.lit("pending")),
        step(1, key % 13 != 0, F.col("scheduled_at"), F.lit("ready")),
        step(2, ran, F.col("started_at"), F.lit("running")),
        step(3, F.col("status") == "completed", F.col("completed_at"), F.when(key % 10 == 1, "failed").otherwise("completed")),
        step(4, (F.col("status") == "pending") & (key % 11 == 0), shift(F.col("created_at"), F.lit(DAY_US)), F.lit("cancelled")),
        step(5, (F.col("status") == "pending") & F.col("deadline").isNotNull() & (key % 17 == 0), F.col("deadline"), F.lit("deadline_missed")),
    )
    return t.select(
        "task_id", "queue_id", "pool", "priority5", "priority7", F.inline(F.filter(steps, lambda s: s.isNotNull()))
    )


def queue_event(spark: SparkSession, folder: str) -> DataFrame:
    """put / get / expire rows per queue, in (ts, seq) order."""
    t = task(spark, folder)
    key = F.col("task_id")
    expired = (F.col("status") == "pending") & F.col("deadline").isNotNull() & (key % 2 == 0)
    steps = F.array(
        F.struct(F.col("created_at").alias("ts"), (key * 4).alias("seq"), F.lit("put").alias("event")),
        F.when(F.col("status") == "completed", F.struct(F.col("completed_at").alias("ts"), (key * 4 + 1).alias("seq"), F.lit("get").alias("event"))),
        F.when(expired, F.struct(F.col("deadline").alias("ts"), (key * 4 + 2).alias("seq"), F.lit("expire").alias("event"))),
    )
    return t.select("queue_id", "task_id", "priority5", F.inline(F.filter(steps, lambda s: s.isNotNull())))


def result(spark: SparkSession, folder: str) -> DataFrame:
    """One row per attempt of a task on a worker; ``(ts, seq)`` is unique within a task."""
    raw = _read(spark, folder, "lineitem")
    ok = F.col("l_returnflag") != "R"
    ended = F.col("l_shipdate").cast("timestamp")
    return raw.select(
        F.col("l_orderkey").alias("task_id"),
        F.col("l_suppkey").alias("worker_id"),
        (F.col("l_suppkey") % 10).alias("pool"),
        ended.alias("ts"),
        ((F.col("l_partkey") * 10_000_000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_quantity") * 100).alias("processing_ms"),
        ok.alias("success"),
        F.when(~ok, F.concat(F.lit("worker "), F.col("l_suppkey").cast("string"), F.lit(" failed"))).alias("error"),
    )


def metric(spark: SparkSession, folder: str) -> DataFrame:
    raw = _read(spark, folder, "events")
    return raw.select(
        F.col("event_type").alias("name"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"),
        F.col("user_id").alias("user_id"),
        F.col("props"),
    )


def gauge_op(spark: SparkSession, folder: str) -> DataFrame:
    """Writes to one gauge per user (``set`` or ``increment``)."""
    raw = _read(spark, folder, "events")
    return raw.select(
        F.col("user_id").alias("series"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "set").otherwise("increment").alias("op"),
        F.col("value"),
    )


def health(spark: SparkSession, folder: str) -> DataFrame:
    """Percent readings of the memory and cpu checks of a host."""
    raw = _read(spark, folder, "events").where(F.col("event_type").isin("view", "click"))
    return raw.select(
        F.col("user_id").alias("host"),
        F.when(F.col("event_type") == "view", "memory").otherwise("cpu").alias("check"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.round(F.col("value") % 100, 2).alias("percent"),
    )


def alert_event(spark: SparkSession, folder: str) -> DataFrame:
    """Alert rows: created by an event, some resolved an hour later."""
    raw = _read(spark, folder, "events").where(F.col("event_type").isin("error", "purchase"))
    ts = F.col("ts").cast("timestamp")
    level = F.element_at(F.array(*[F.lit(x) for x in ("info", "warning", "error", "critical")]), (F.col("event_id") % 4 + 1).cast("int"))
    created = F.struct(ts.alias("ts"), F.lit("create").alias("op"))
    resolved = F.when(F.col("event_id") % 3 == 0, F.struct(shift(ts, F.lit(3_600_000_000)).alias("ts"), F.lit("resolve").alias("op")))
    return raw.select(
        F.col("event_id").alias("alert_id"),
        level.alias("level"),
        F.col("event_type").alias("source"),
        F.inline(F.filter(F.array(created, resolved), lambda s: s.isNotNull())),
    )


def resource_claim(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of tasks on resources in the order they were made."""
    raw = _read(spark, folder, "lineitem")
    return raw.select(
        F.col("l_partkey").alias("resource"),
        F.col("l_orderkey").alias("task_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


def resource_hold(claims: DataFrame) -> DataFrame:
    """The earliest claim of a resource holds it."""
    return claims.groupBy("resource").agg(F.min_by("task_id", F.struct("ts", "task_id")).alias("task_id"))


def resource_wait(claims: DataFrame) -> DataFrame:
    """All other tasks that claim the resource wait for it, once each."""
    first = claims.groupBy("resource", "task_id").agg(F.min("ts").alias("ts"))
    holder = resource_hold(claims).withColumnRenamed("task_id", "_holder")
    return first.join(holder, "resource").where(F.col("task_id") != F.col("_holder")).drop("_holder")


def pool(spark: SparkSession, folder: str) -> DataFrame:
    """Worker limits per task type, from the suppliers grouped into types."""
    raw = _read(spark, folder, "supplier")
    kind = F.element_at(F.array(F.lit("compute"), F.lit("io"), F.lit("memory")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return raw.groupBy(kind.alias("task_type")).agg(
        F.min(F.col("s_nationkey") % 5 + 1).cast("bigint").alias("min_workers"),
        F.max(F.col("s_nationkey") % 5 + 6).cast("bigint").alias("max_workers"),
    )


def pool_tick(spark: SparkSession, folder: str) -> DataFrame:
    """Queue size and active workers per event type and hour."""
    raw = _read(spark, folder, "events")
    return raw.groupBy(
        F.col("event_type").alias("task_type"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")
    ).agg(
        F.count(F.lit(1)).alias("queue_size"),
        F.count_if(F.col("user_id") % 3 == 0).alias("active_workers"),
        F.lit(10).cast("bigint").alias("total_workers"),
    )


def memory_op(spark: SparkSession, folder: str) -> DataFrame:
    raw = _read(spark, folder, "events")
    return raw.select(
        F.col("user_id").alias("memory_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "signup", "store").otherwise("retrieve").alias("op"),
        F.get_json_object("props", "$.k").cast("bigint").alias("key"),
        F.col("value"),
    )


def log_line(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON log line per event, in the structured log format."""
    raw = _read(spark, folder, "events")
    error = F.col("event_type") == "error"
    timed = F.col("event_type").isin("click", "error")
    doc = F.struct(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(error, "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.lit("app."), F.col("event_type")).alias("logger"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
        F.lit("jobs").alias("module"),
        F.lit("run").alias("function"),
        (F.col("event_id") % 300).alias("line"),
        F.col("user_id").alias("thread_id"),
        F.concat(F.lit("worker-"), F.col("user_id").cast("string")).alias("thread_name"),
        F.when(
            error,
            F.struct(
                F.lit("ValueError").alias("type"),
                F.concat(F.lit("bad value "), F.col("value").cast("string")).alias("message"),
                F.array(F.lit("line one"), F.lit("line two")).alias("traceback"),
            ),
        ).alias("exception"),
        F.when(timed, F.col("value")).alias("duration_ms"),
        F.when(timed, ~error).alias("success"),
        F.when(timed & (F.col("event_id") % 2 == 0), F.lit(True)).alias("performance_metric"),
        F.get_json_object("props", "$.k").alias("shard"),
        F.when(
            timed,
            F.struct(
                F.concat(F.lit("op"), (F.col("event_id") % 7).cast("string")).alias("operation"),
                F.when(F.col("event_id") % 2 == 0, "reactive").alias("cognitive_layer"),
            ),
        ).alias("context"),
    )
    return raw.select(F.to_json(doc).alias("value"))


def config_doc(spark: SparkSession, folder: str) -> DataFrame:
    """Nested JSON documents: a scope has one document per task of the queue."""
    # a file of orders makes documents ten times its size: they are dealt to all cores before they are made, a scope's
    # up to a million keys together, which map-side combining of a scope's paths gains from
    block = F.floor(F.col("o_orderkey") / 1_000_000)
    raw = _read(spark, folder, "orders").select("o_orderkey", "o_custkey").repartition(3 * spark.sparkContext.defaultParallelism, "o_custkey", block)
    key = F.col("o_orderkey")
    nested = F.struct(
        F.concat(F.lit("web-"), (key % 17).cast("string")).alias("name"),
        F.struct(
            F.concat(F.lit("host"), (key % 9).cast("string")).alias("host"),
            (key % 70000).alias("port"),
            F.struct((key % 2 == 0).alias("enabled")).alias("ssl"),
        ).alias("server"),
        F.struct(
            F.concat(F.lit("pw"), (key % 5).cast("string")).alias("password"),
            F.concat(F.lit("http://db"), (key % 4).cast("string"), F.lit("/${REGION}/${TIER:-basic}")).alias("url"),
            F.when(key % 6 != 0, F.col("o_custkey") % 20).alias("pool_size"),
        ).alias("db"),
        F.array((key % 3).cast("string"), F.lit("x")).alias("tags"),
    )
    flat = F.struct(F.concat(F.lit("web-"), (key % 17).cast("string")).alias("name"), F.lit("down").alias("server"))
    return raw.select(
        F.col("o_custkey").alias("scope"),
        F.concat(F.lit("s"), (key % 3).cast("string")).alias("source"),
        (key % 5).alias("priority"),
        key.alias("loaded_seq"),
        F.when(key % 7 == 0, F.to_json(flat)).otherwise(F.to_json(nested)).alias("doc"),
    )


def env_var(spark: SparkSession, folder: str) -> DataFrame:
    """Environment variables per scope."""
    raw = _read(spark, folder, "customer")
    key = F.col("c_custkey")
    rows = F.array(
        F.when(key % 2 == 0, F.struct(F.lit("REGION").alias("name"), F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("value"))),
        F.when(key % 3 == 0, F.struct(F.lit("TIER").alias("name"), F.lower("c_mktsegment").alias("value"))),
        F.struct(F.lit("APP_SERVER__PORT").alias("name"), (key % 9000).cast("string").alias("value")),
        F.struct(F.lit("APP_SERVER__HOST").alias("name"), F.col("c_name").alias("value")),
        F.struct(F.lit("APP_DEBUG").alias("name"), F.when(key % 2 == 0, "true").otherwise("false").alias("value")),
    )
    return raw.select(key.alias("scope"), F.inline(F.filter(rows, lambda r: r.isNotNull())))


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All canonical tables, registered as temporary views as well."""
    views = {name: globals()[name](spark, folder) for name in TABLE_NAMES}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def counter_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of a cumulative counter per event type that restarts every 500 events."""
    raw = _read(spark, folder, "events")
    return raw.select(
        F.col("event_type").alias("name"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 500).cast("double").alias("value"),
    )


def alert_rule(spark: SparkSession) -> DataFrame:
    """One rule per event type, with hold times of hours to fit the density of the samples."""
    from opslens.functions.fixed import RULE_SCHEMA

    rows = [
        ("HighView", "view", {}, ">", 50.0, 3600, "warning", "view"),
        ("HighClick", "click", {"user": "7"}, ">", 75.0, 7200, "warning", "click"),
        ("HighError", "error", {}, ">", 20.0, 18000, "critical", "error"),
        ("LowSignup", "signup", {}, "<", 125.0, 36000, "info", "signup"),
        ("HighPurchase", "purchase", {}, ">=", 10.0, 3600, "warning", "purchase"),
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)
