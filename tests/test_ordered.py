"""Chunked windows against plain windows and brute force, with one hot key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window as W, functions as F

from opslens.operators.alerts import breach_runs
from opslens.operators.flow import admit, apply_level_moves
from opslens.operators.logs import enrich_with_context
from opslens.operators.throttle import throttle
from opslens.plans import ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(15)}", start + timedelta(seconds=rng.randrange(0, 864000, 50)), i, rng.randrange(-5, 9)) for i in range(3000)]
    return spark.createDataFrame(data, "k string, ts timestamp, seq bigint, v bigint").persist()


def same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_running_sum(rows):
    w = W.partitionBy("k").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    got = ordered.running_sum(rows, ["k"], ["ts", "seq"], F.col("v"), ordered.time_chunk("ts"), "s")
    same(got, rows.withColumn("s", F.sum("v").over(w)))


def test_running_sum_without_keys(rows):
    w = W.orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    got = ordered.running_sum(rows, [], ["ts", "seq"], F.col("v"), ordered.time_chunk("ts", "3 hours"), "s")
    same(got, rows.withColumn("s", F.sum("v").over(w)))


def test_position(rows):
    w = W.partitionBy("k").orderBy(F.col("v").desc(), "seq")
    got = ordered.position(rows, ["k"], [F.col("v").desc(), F.col("seq")], [-F.col("v"), ordered.number_chunk("seq", 100)], "r")
    same(got, rows.withColumn("r", F.row_number().over(w).cast("bigint")))


def test_previous(rows):
    w = W.partitionBy("k").orderBy("ts", "seq")
    got = ordered.previous(rows, ["k"], ["ts", "seq"], ["v"], ordered.time_chunk("ts", "2 hours"), "p").withColumn("p", F.col("p.v"))
    same(got, rows.withColumn("p", F.lag("v").over(w)))


def test_last_before_inclusive(rows):
    w = W.partitionBy("k").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    value = F.when(F.col("v") > 6, F.col("seq"))
    got = ordered.last_before(rows, ["k"], ["ts", "seq"], value, ordered.time_chunk("ts", "2 hours"), "p", inclusive=True)
    same(got, rows.withColumn("p", F.last(value, ignorenulls=True).over(w)))


def test_first_n(rows):
    w = W.partitionBy("k").orderBy("ts", "seq")
    same(ordered.first_n(rows, ["k"], ["ts", "seq"], 7), rows.withColumn("rn", F.row_number().over(w)).where("rn <= 7"))


def test_hot_key_is_split(rows):
    plan = ordered.running_sum(rows, ["k"], ["ts", "seq"], F.col("v"), ordered.time_chunk("ts"), "s")._jdf.queryExecution().toString()
    assert "windowspecdefinition(k#" in plan and "_chunk0" in plan


def in_order(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.ts, r.seq)):
        out.setdefault(r.k, []).append(r)
    return out


def test_admit(rows):
    events = rows.withColumn("event", F.when(F.col("v") > 0, "put").otherwise("get"))
    got = {r.seq: (r.accepted, r.depth) for r in admit(events, 4, ["k"], "1 day").collect()}
    for log in in_order(events).values():
        depth = 0
        for r in log:
            ok = depth < 4 if r.event == "put" else depth > 0
            depth += (1 if r.event == "put" else -1) if ok else 0
            assert got[r.seq] == (ok, depth)


def test_level_moves(spark, rows):
    moves = rows.select("k", "ts", "seq", F.when(F.col("v") > 1, 1).otherwise(-1).cast("bigint").alias("move"))
    start = rows.select("k").distinct().withColumn("level", F.lit(2)).unionByName(spark.createDataFrame([("idle", 1)], "k string, level int"))
    got = {r.k: r.final_level for r in apply_level_moves(start, moves, 4, "k", "1 day").collect()}
    for k, log in in_order(moves).items():
        level = 2
        for r in log:
            level = max(0, min(3, level + r.move))
        assert got[k] == level
    assert got["idle"] == 1


@pytest.mark.parametrize("with_forced", [False, True])
def test_throttle(rows, with_forced):
    runs = rows.withColumn("force", (F.col("seq") % 37 == 0) if with_forced else F.lit(False))
    got = {r.seq: r.kept for r in throttle(runs, ["k"], "2 hours", "force", "1 day").collect()}
    for log in in_order(runs).values():
        last = None
        for r in log:
            take = r.force or last is None or r.ts - last >= timedelta(hours=2)
            last = r.ts if take else last
            assert got[r.seq] == take


def test_context(rows):
    kind = F.when(F.col("v") < -2, "exit").when(F.col("v") < 2, "enter").otherwise("log")
    logs = rows.select("k", "ts", "seq", kind.alias("kind"), F.to_json(F.create_map(F.concat(F.lit("a"), (F.col("seq") % 4).cast("string")), F.col("seq").cast("string"))).alias("context"))
    got = {r.seq: (r.depth, r.context) for r in enrich_with_context(logs, ["k"], "1 day").collect()}
    for log in in_order(logs).values():
        stack = []
        for r in log:
            if r.kind == "enter":
                stack.append({**(stack[-1] if stack else {}), f"a{r.seq % 4}": str(r.seq)})
            elif r.kind == "exit":
                stack = stack[:-1]
            else:
                assert got[r.seq] == (len(stack), stack[-1] if stack else None)


@pytest.mark.parametrize("limit", [-4, 2, 8])
def test_breach_runs(rows, limit):
    samples = rows.select(F.lit("r").alias("rule"), F.col("k").alias("series"), "ts", "seq", (F.col("v") > limit).alias("breach"), F.lit(7200).cast("bigint").alias("hold_seconds"))
    got = {r.seq: (r.since, r.firing) for r in breach_runs(samples, "3 hours").collect()}
    for log in in_order(samples.withColumn("k", F.col("series"))).values():
        since = None
        for r in log:
            since = (since or r.ts) if r.breach else None
            assert got[r.seq] == (since, since is not None and r.ts - since >= timedelta(hours=2))


def test_null_keys_and_times(spark):
    data = [(k, None if i % 5 == 0 else datetime(2024, 1, 1) + timedelta(minutes=37 * i), i, i % 4) for i in range(60) for k in (None, "a")]
    rows = spark.createDataFrame(data, "k string, ts timestamp, seq bigint, v bigint")
    w = W.partitionBy("k").orderBy("ts", "seq")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    chunk = ordered.time_chunk("ts")
    same(ordered.running_sum(rows, ["k"], ["ts", "seq"], F.col("v"), chunk, "s"), rows.withColumn("s", F.sum("v").over(upto)))
    same(ordered.position(rows, ["k"], ["ts", "seq"], chunk, "n"), rows.withColumn("n", F.row_number().over(w)))
    odd = F.when(F.col("v") > 1, F.col("seq"))
    same(ordered.last_before(rows, ["k"], ["ts", "seq"], odd, chunk, "l"), rows.withColumn("l", F.last(odd, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))))
    same(ordered.first_n(rows, ["k"], ["ts", "seq"], 3), rows.withColumn("rn", F.row_number().over(w)).where("rn <= 3"))
    samples = rows.select(F.lit("r").alias("rule"), F.col("k").alias("series"), "ts", "seq", (F.col("v") > 1).alias("breach"), F.lit(60).cast("bigint").alias("hold_seconds"))
    assert breach_runs(samples, "3 hours").count() == len(data)


def test_values_travel_once(spark):
    """The value of a row is taken behind the last exchange, not carried through it beside its columns."""
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 12, None), ("b", 3, "z")], "k string, seq long, value string")
    out = ordered.previous(rows, ["k"], ["seq"], ["value"], ordered.number_chunk("seq", 10), "prev")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("CASE WHEN (_mark") < plan.index("Exchange")
    assert sorted((r.k, r.seq, r.prev and r.prev.value) for r in out.collect()) == [("a", 1, None), ("a", 5, "x"), ("a", 12, "y"), ("b", 3, None)]
