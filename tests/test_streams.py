import random
import sys
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.session import scratch_path
from opslens.sources import tables
from opslens.streaming import jobs, sinks, state


def released(machine, rows, cuts):
    """The machine over rows that come in batches, as the stream runs it: waiting rows are applied up to each mark."""
    value, waiting, out = machine.start, [], []
    for batch, mark in cuts:
        waiting = sorted(waiting + batch)
        value, more = state.replay(machine, value, [r for r in waiting if r[0] <= mark], mark)
        waiting = [r for r in waiting if r[0] > mark]
        out += more
    return value, waiting, out


@pytest.mark.parametrize(
    "machine, extra",
    [
        (state.TaskStates(50, 400), lambda rng: (rng.choice(["pending", "ready", "running", "completed", "blocked"]),)),
        (state.Throttle(30), lambda rng: ()),
        (state.RuleStates(), lambda rng: (rng.random() < 0.6, 20)),
        (state.LastValue({"success": "boolean"}, 25), lambda rng: (rng.random() < 0.5,)),
        (state.First({"x": "int"}, 60), lambda rng: (rng.randrange(9),)),
    ],
)
def test_any_cut_gives_the_same(machine, extra):
    rng = random.Random(3)
    for _ in range(100):
        rows = sorted((rng.randrange(600), i, *extra(rng)) for i in range(rng.randrange(30)))
        whole = state.replay(machine, machine.start, rows, 2000)
        # rows come up to 40 late, in any order
        marks = sorted(rng.randrange(700) for _ in range(4))
        cuts, left = [], list(rows)
        for mark in marks:
            batch = [r for r in left if r[0] <= mark or (r[0] <= mark + 40 and rng.random() < 0.5)]
            left = [r for r in left if r not in batch]
            cuts.append((rng.sample(batch, len(batch)), mark))
        value, waiting, out = released(machine, rows, cuts + [(left, 2000)])
        assert not waiting and (value, out) == whole


def test_state_is_freed(spark):
    ends = {"completed": None, "running": ("running", 100, True)}
    for event, left in ends.items():
        value, _ = state.replay(state.TaskStates(10, 1000), state.TaskStates.start, [(0, 0, "ready"), (50, 1, "running"), (100, 2, event)], 5000)
        assert value == (left or state.TaskStates.start)
    assert state.replay(state.Throttle(30), (None,), [(0, 0)], 29)[0] == (0,) and state.replay(state.Throttle(30), (None,), [(0, 0)], 30)[0] == (None,)


def test_ids_of_any_type_null_times_and_late_rows(spark):
    path = scratch_path(spark, "events")
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    files = [
        [("a", at(100), 1, "running"), ("a", at(90), None, "ready"), (None, at(95), 2, "pending"), ("b", None, 3, "ready")],
        [(None, at(96), 5, "ready"), ("a", at(97), 6, "blocked"), ("z", at(500), 7, "pending")],
        # the mark stands at 40 by then: the row of 30 is late
        [("a", at(30), 4, "pending"), ("z", at(900), 8, "ready")],
    ]
    schema = "task_id string, ts timestamp, seq long, event string"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.read_stream(spark, path, "*.parquet", 1)
    out = jobs.run_available(state.task_state_stream(stream, 50_000_000, "1 minute"), "states", 2)
    start = int(at(0).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000
    got = sorted((r.task_id or "", (r.at_us - start) // 1_000_000, r.kind, r.from_status, r.to_status) for r in out.collect())
    assert got == [
        ("", 96, "move", "pending", "ready"),
        ("a", 97, "move", "ready", "blocked"),
        ("a", 100, "illegal", "blocked", "running"),
        ("a", 150, "stuck", "running", "running"),
    ]


def test_delivery(spark, data):
    path = scratch_path(spark, "deliver")
    errors, seen = [], []

    def bad(_df, _id):
        raise ValueError("down")

    def count(df, batch_id):
        seen.append(df.count())

    stream = tables.metric(spark, tables.as_stream(data)).select("name", "seq")
    handlers = {"bad": bad, "count": count, "files": sinks.append_once(f"{path}/rows")}
    query = sinks.deliver(stream, handlers, f"{path}/state", lambda name, _id, text: errors.append((name, text)))
    query.awaitTermination()
    assert errors == [("bad", "down")] and sum(seen) == 1000
    assert spark.read.parquet(f"{path}/rows").count() == 1000


def test_a_repeated_batch_is_delivered_once(spark, data, tmp_path):
    """The last batch is not committed, so it comes again: only the handler that failed gets it."""
    path, calls, broken = str(tmp_path), [], [True]

    def fine(df, batch_id):
        calls.append(("fine", batch_id, df.count()))

    def flaky(df, batch_id):
        if broken[0]:
            raise ValueError("down")
        calls.append(("flaky", batch_id, df.count()))

    stream = tables.metric(spark, tables.as_stream(data)).select("name", "seq")
    handlers = {"fine": fine, "flaky": flaky}
    sinks.deliver(stream, handlers, f"{path}/state").awaitTermination()
    assert calls == [("fine", 0, 1000)]
    assert {(r.batch_id, r.handler, r.error) for r in sinks.read_ledger(spark, f"{path}/state").collect()} == {(0, "fine", None), (0, "flaky", "down")}
    for name in ("0", ".0.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    broken[0] = False
    sinks.deliver(stream, handlers, f"{path}/state").awaitTermination()
    sinks.deliver(stream, handlers, f"{path}/state").awaitTermination()
    assert calls == [("fine", 0, 1000), ("flaky", 0, 1000)]


def _stream(spark, parts, schema):
    path = scratch_path(spark, "rows")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return jobs.read_stream(spark, path, "*.parquet", 1)


def test_keys_share_state_values(spark):
    """State values and calls of Python are as many as buckets, not keys; whole numbers beside nulls stay exact."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    big = 2**60 + 1
    first = [(big + k, at(k % 50), k, big - k if k % 3 else None, at(k) if k % 5 else None, k / 2 if k % 2 else None) for k in range(300)]
    first += [(None, at(9), 1, big, None, 1.0), (None, at(3), 2, None, at(1), 2.0)]
    again = [(k, at(70), s, 0, None, 0.0) for k, _, s, *_ in first if k is not None] + [(0, at(5000), 0, 0, None, 0.0)]
    stream = _stream(spark, [first, again], "task_id long, ts timestamp, seq long, worker long, seen timestamp, x double")
    columns = {"worker": "bigint", "seen": "timestamp", "x": "double"}
    out = state.in_event_time(stream, ["task_id"], state.First(columns, 10**12), "10 minutes", buckets=4)
    path = scratch_path(spark, "shared")
    query = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 4
    got = {r.task_id: (r.seq, r.worker, r.seen, r.x) for r in spark.read.schema(out.schema).parquet(f"{path}/rows").collect()}
    want = {r[0]: (r[2], *r[3:]) for r in first if r[2:] != (1, big, None, 1.0)}
    assert repr(sorted(got.items(), key=str)) == repr(sorted(want.items(), key=str)) and len(got) == 301


def test_a_part_of_several_files_comes_at_once(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    for k in range(3):
        spark.range(100).withColumn("part", F.lit(k)).repartition(4).write.mode("append").parquet(path)
    seen = []
    stream = tables._read(spark, tables.as_parts(str(tmp_path), 4), "t")
    stream.writeStream.foreachBatch(lambda df, _: seen.append({(r.part, r["count"]) for r in df.groupBy("part").count().collect()})).option(
        "checkpointLocation", f"{tmp_path}/state"
    ).trigger(availableNow=True).start().awaitTermination()
    assert seen == [{(0, 100)}, {(1, 100)}, {(2, 100)}]


def test_a_hot_key_is_not_held_as_python_objects(spark):
    """Rows of a key that wait are arrays; only a slice of them at a time are Python objects."""

    class Probe(state.Machine):
        outputs = "blocks bigint"

        def step(self, value, row):
            return value, [(sys.getallocatedblocks(),)] if row[1] % 1000 == 0 else []

    def blocks(n):
        rows = spark.range(n).select(F.lit("a").alias("check"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id")).alias("ts"), F.col("id").alias("seq"))
        path = scratch_path(spark, "hot")
        rows.coalesce(1).write.parquet(path)
        spark.createDataFrame([("b", datetime(2024, 6, 1), 1)], rows.schema).coalesce(1).write.mode("append").parquet(path)
        stream = jobs.read_stream(spark, path, "*.parquet", 1, rows.schema)
        got = [r.blocks for r in jobs.run_available(state.in_event_time(stream, ["check"], Probe(), "1 minute"), "hot", 1).collect()]
        assert len(got) == n // 1000
        return max(got)

    assert blocks(200_000) - blocks(20_000) < 150_000


def test_the_p95_of_a_warning_is_exact(spark):
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000))
    rows = spark.range(400_000, numPartitions=4).select(F.lit(100).alias("priority7"), at.alias("ts"), (F.col("id") * 7919 % 400_000 + 1).cast("double").alias("value"))
    got = jobs.stream_p95_trend(rows).collect()
    assert [(r["count"], r.p95) for r in got] == [(400_000, 380_000.0)]


def test_a_join_of_streams_counts_no_state_rows(spark, tmp_path):
    """State partitions follow the rows; settings hold for one query, and the result does not depend on them."""
    at = lambda day: datetime(2024, 1, 1) + timedelta(days=day)
    tasks = _stream(spark, [[(k, at(k % 50)) for k in range(300)] + [(999, at(200))]], "task_id long, created_at timestamp")
    results = _stream(spark, [[(k, k, True, at(k % 50 + k % 40)) for k in range(0, 300, 2)] + [(999, 1, True, at(300))]], "task_id long, worker_id long, success boolean, ts timestamp")
    name, seen = next(iter(jobs.JOIN_SETTINGS)), []
    path = f"{tmp_path}/t.parquet"
    spark.range(95).write.parquet(path)
    assert jobs.state_partitions(spark, path, least=1, rows_each=10) == 10 and jobs.state_partitions(spark, path, least=1) == 1
    for settings in (None, jobs.JOIN_SETTINGS):
        out = jobs.run_available(jobs.join_task_result_stream(tasks, results), "join", 3, settings)
        seen.append(sorted(map(str, out.collect())))
        assert spark.conf.get(name, None) is None
    assert seen[0] == seen[1] and len(seen[0]) == 300


@pytest.mark.parametrize("gap", [0, 1, 30])
def test_a_throttle_of_arrays_equals_that_of_rows(gap):
    rng = random.Random(7)
    machine = state.Throttle(gap)
    for _ in range(200):
        rows = sorted((rng.randrange(300), i) for i in range(rng.randrange(1, 80)))
        start = (None,) if rng.random() < 0.3 else (rng.randrange(-40, rows[0][0] + 1),)
        after, out = state.replay(machine, start, rows, rows[-1][0] - 1)
        at, seq = (np.array(c, np.int64) for c in zip(*rows))
        got, columns = machine.replay_all(start, at, seq)
        assert list(zip(*(c.tolist() for c in columns))) == out
        # a run is only remembered while the gap lasts, which the state of rows may already have forgotten
        assert got == after or (after == machine.start and got[0] + gap < rows[-1][0])


def test_hot_checks_of_a_throttle_are_replayed_as_arrays(spark):
    class ByArrays(state.Throttle):
        def step(self, state, row):
            # the single row that moves the watermark on
            assert row[1] == -1, "one by one"
            return state, []

    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=7 * i), i) for k in ("a", "b", None) for i in range(500)]
    stream = _stream(spark, [rows, [("z", datetime(2024, 1, 2), -1)]], "check string, ts timestamp, seq long")
    out = state.in_event_time(stream, ["check"], ByArrays(60_000_000), "0 seconds")
    got = jobs.run_available(out, "arrays", 2, state.HOT_SETTINGS).collect()
    # nine steps of seven seconds are the first beyond a minute
    assert sorted((r["check"] or "", r.seq, r.kept) for r in got) == sorted((k, i, i % 9 == 0) for k in ("", "a", "b") for i in range(500))
