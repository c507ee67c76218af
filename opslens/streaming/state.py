"""Streaming jobs with custom state per key, in event-time order.

Rows wait in the state of their key until the watermark has passed them, and are then applied in the
order of ``(ts, seq)``, whatever files or micro-batches they came in. So results do not depend on how a
stream is cut. Rows later than the watermark allows are dropped, as are rows without a time; rows without
``seq`` come first among those of one time. A key's state is a few values and the rows that wait,
which ``late`` bounds; it is freed when the machine is back at its start and nothing waits. Keys share state
values by a hash: waiting rows are plain arrays there, and a call of Python serves a whole bucket of keys.

The last rows of a stream that has ended are held until the watermark moves on: ``beats`` is a stream of
times (column ``ts``) that moves it without being data.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, DataType, DoubleType, FloatType, IntegralType, LongType, StructField, StructType, TimestampType

from opslens.functions.fixed import LIFECYCLE
from opslens.operators.alerts import match_alert_rules
from opslens.plans.ordered import width_us

# buckets of keys: one state value and one call of Python each
BUCKETS = 512
# rows that are Python objects at a time
SLICE = 16_384
# rows per key from which keys are replayed as arrays
MANY = 64
# Settings for narrow rows of a few hot keys: Spark sends a bucket's state along with each of its Arrow batches, so what
# a bucket costs is the product of these and the rows that wait
HOT_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "250000"}


class Machine:
    """What happens to one key. Methods take and return states, plain tuples, and never change anything else. Rows are ``(at_us, seq, *columns)``, results are tuples of ``outputs``."""

    columns: Sequence[str] = ()
    outputs: str = ""
    start: tuple = ()

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        """The state after a row, and what it gives."""
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """When something happens without a row; after all rows of that time."""
        return None

    def on_due(self, state: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    #: For machines without columns, where defined: ``(state, at_us, seq)`` with all rows of a key as arrays, to the state after
    #: them and the outputs as arrays, the same as ``replay`` up to the last of the rows.
    replay_all = None


def replay(machine: Machine, state: tuple, rows: Sequence[tuple], until_us: int) -> tuple[tuple, list[tuple]]:
    """Apply rows in order and what falls due between them and up to a time."""
    out: list[tuple] = []

    def pass_time(state: tuple, before: int) -> tuple:
        while (due := machine.due(state)) is not None and due < before:
            state, more = machine.on_due(state)
            out.extend(more)
        return state

    for row in rows:
        state, more = machine.step(pass_time(state, row[0]), row)
        out.extend(more)
    return pass_time(state, until_us + 1), out


def in_event_time(rows: DataFrame, keys: Sequence[str], machine: Machine, late: str, beats: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Keys and the machine's outputs. ``rows`` has the keys, ``ts``, ``seq`` and the machine's columns.

    Python is called once per bucket of keys, not per key. ``buckets`` belongs to the checkpoint: a stream keeps the
    number it starts with. Keys are numbers, texts, times, booleans or bytes."""
    keys = list(keys)
    columns = [*keys, *machine.columns]
    types = {c: rows.schema[c].dataType for c in columns}
    outputs = StructType([*[StructField(k, types[k]) for k in keys], *StructType.fromDDL(machine.outputs)])
    # times travel as whole microseconds, and with a default and a mark where null: pandas would make doubles of whole numbers
    schema = StructType([StructField(f.name, LongType() if isinstance(f.dataType, TimestampType) else f.dataType) for f in outputs])
    names = ["_at", "_seq", "_nulls", *[f"_c{i}" for i in range(len(columns))]]
    nan_keys = [i for i, k in enumerate(keys) if isinstance(types[k], (DoubleType, FloatType))]

    def as_tuples(table: list[np.ndarray], index: np.ndarray) -> Iterator[tuple[tuple, tuple]]:
        """Key and row of the places in the index."""
        at, seq, nulls, *cells = (a[index] for a in table)
        lists = [[None if n >> i & 1 else x for x, n in zip(c.tolist(), nulls.tolist())] if (nulls >> i & 1).any() else c.tolist() for i, c in enumerate(cells)]
        for i in nan_keys:
            lists[i] = ["NaN" if x != x else x for x in lists[i]]
        return zip(zip(*lists[: len(keys)]), zip(at.tolist(), seq.tolist(), *lists[len(keys) :]))

    def by_key(table: list[np.ndarray], index: np.ndarray) -> list[np.ndarray]:
        """The index, in its order, by key."""
        code = np.zeros(len(index), np.int64)
        for i in range(len(keys)):
            own = (pd.factorize(table[3 + i][index])[0] + 1) * 2 + (table[2][index] >> i & 1)
            code = np.unique(code * (own.max() + 1) + own, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        return np.split(index[order], np.flatnonzero(np.diff(code[order])) + 1)

    def as_columns(key: tuple, columns: list[np.ndarray], low: int) -> pd.DataFrame:
        part = [c[low : low + SLICE] for c in columns]
        key_of = (float(x) if i in nan_keys and x is not None else x for i, x in enumerate(key))
        return pd.DataFrame(dict(zip(schema.names, [*(pd.Series([x] * len(part[0]), dtype=object) for x in key_of), *part])))

    def as_frame(out: list[tuple]) -> pd.DataFrame:
        cells = [list(c) for c in zip(*out)]
        for i in nan_keys:
            cells[i] = [x if x is None else float(x) for x in cells[i]]
        return pd.DataFrame(dict(zip(schema.names, cells)), dtype=object)

    def update(_key, frames: Iterator[pd.DataFrame], state: GroupState):
        values, parts = {}, []
        if state.exists:
            values, held = pickle.loads(state.get[0])
            parts = [held] if held else []
        if not state.hasTimedOut:
            for frame in frames:
                own = ~frame["_beat"].to_numpy(dtype=bool)
                if own.any():
                    parts.append([frame[c].to_numpy()[own] for c in names])
        mark, waiting = state.getCurrentWatermarkMs() * 1000, []
        if parts:
            table = [np.concatenate(c) for c in zip(*parts)]
            order = np.lexsort((table[1], table[0]))
            ready = int(np.searchsorted(table[0][order], mark, side="right"))
            groups = by_key(table, order[:ready]) if ready and machine.replay_all else []
            one_by_one = ready < MANY * len(groups) or not groups
            for group in [] if one_by_one else groups:
                key = next(as_tuples(table, group[:1]))[0]
                values[key], columns = machine.replay_all(values.get(key, machine.start), table[0][group], table[1][group])
                for low in range(0, len(columns[0]), SLICE):
                    yield as_columns(key, columns, low)
            for low in range(0, ready if one_by_one else 0, SLICE):
                of_key: dict[tuple, list[tuple]] = {}
                for key, row in as_tuples(table, order[low : min(low + SLICE, ready)]):
                    of_key.setdefault(key, []).append(row)
                out = []
                for key, some in of_key.items():
                    values[key], more = replay(machine, values.get(key, machine.start), some, some[-1][0] - 1)
                    out.extend((*key, *o) for o in more)
                if out:
                    yield as_frame(out)
            if ready < len(order):
                left = np.sort(order[ready:])
                waiting = [a[left] for a in table]
        times, out, passed = [int(waiting[0].min())] if waiting else [], [], {}
        for key, value in values.items():
            due = machine.due(value)
            if due is not None and due <= mark:
                value, more = replay(machine, value, (), mark)
                out.extend((*key, *o) for o in more)
                due = machine.due(value)
            if value != machine.start:
                passed[key] = value
                if due is not None:
                    times.append(due)
        if passed or waiting:
            state.update((pickle.dumps((passed, waiting), pickle.HIGHEST_PROTOCOL),))
            if times:
                # a timer goes off once the watermark is beyond it
                state.setTimeoutTimestamp(max(-(-min(times) // 1000) - 1, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        for low in range(0, len(out), SLICE):
            yield as_frame(out[low : low + SLICE])

    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket")
    rows = rows.select(*keys, "ts", F.coalesce("seq", F.lit(-(2**63))).alias("_seq"), *machine.columns, F.lit(False).alias("_beat"))
    if beats is not None:
        rows = rows.unionByName(beats.select("ts", F.lit(True).alias("_beat")), allowMissingColumns=True)
    # beats have to reach the watermark, so they are left out only behind it, under the null key
    rows = rows.where(F.col("ts").isNotNull()).withWatermark("ts", late)
    nulls = sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(columns)), F.lit(0).cast("long"))
    rows = rows.select(
        bucket, "ts", F.unix_micros("ts").alias("_at"), F.coalesce("_seq", F.lit(0).cast("long")).alias("_seq"), "_beat", nulls.alias("_nulls"),
        *[_carried(c, types[c]).alias(f"_c{i}") for i, c in enumerate(columns)],
    )
    out = rows.groupBy("_bucket").applyInPandasWithState(update, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*[F.timestamp_micros(f.name).alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f.name) for f in outputs])


def _carried(name: str, kind: DataType) -> Column:
    """A column as it is sent to Python: numbers and booleans without nulls, times as microseconds."""
    if isinstance(kind, TimestampType):
        return F.coalesce(F.unix_micros(name), F.lit(0).cast("long"))
    if isinstance(kind, (IntegralType, DoubleType, FloatType, BooleanType)):
        return F.coalesce(F.col(name), F.lit(0).cast(kind))
    return F.col(name)


class TaskStates(Machine):
    """Moves between statuses; a running task is reported once when its time is over. A final status is
    remembered for ``retain_us``, so that what follows it shows as illegal."""

    columns = ("event",)
    outputs = "kind string, from_status string, to_status string, at_us bigint"
    start = (None, 0, False)
    allowed = frozenset(map(tuple, LIFECYCLE))
    final = frozenset(b for _, b in LIFECYCLE) - frozenset(a for a, _ in LIFECYCLE)

    def __init__(self, limit_us: int, retain_us: int):
        self.limit_us, self.retain_us = limit_us, retain_us

    def step(self, state, row):
        status, at, event = state[0], row[0], row[2]
        out = [] if status is None else [("move" if (status, event) in self.allowed else "illegal", status, event, at)]
        return (event, at, False), out

    def due(self, state):
        status, since, told = state
        if status == "running" and not told:
            return since + self.limit_us
        return since + self.retain_us if status in self.final else None

    def on_due(self, state):
        status, since, _ = state
        if status == "running":
            return (status, since, True), [("stuck", status, status, since + self.limit_us)]
        return self.start, []


def task_state_stream(
    events: DataFrame, limit_us: int = 300_000_000, late: str = "1 minute", retain: str = "1 day", beats: DataFrame | None = None
) -> DataFrame:
    """Status of tasks as it changes: ``move`` for allowed and ``illegal`` for other steps, and
    ``stuck`` when a task has been running longer than the limit."""
    return in_event_time(events, ["task_id"], TaskStates(limit_us, width_us(retain)), late, beats)


class Throttle(Machine):
    """At most one kept run per gap; once the gap is over the next run is kept anyway."""

    outputs = "seq bigint, at_us bigint, kept boolean"
    start = (None,)

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def step(self, state, row):
        take = state[0] is None or row[0] - state[0] >= self.gap_us
        return (row[0] if take else state[0],), [(row[1], row[0], take)]

    def replay_all(self, state, at, seq):
        # the run that is kept next, if one is
        after = np.maximum(np.searchsorted(at, at + self.gap_us), np.arange(1, len(at) + 1)).tolist()
        kept = np.zeros(len(at), bool)
        i = 0 if state[0] is None else int(np.searchsorted(at, state[0] + self.gap_us))
        took = []
        while i < len(at):
            took.append(i)
            i = after[i]
        kept[took] = True
        return (int(at[took[-1]]) if took else state[0],), [seq, at, kept]

    def due(self, state):
        return None if state[0] is None else state[0] + self.gap_us

    def on_due(self, state):
        return self.start, []


def throttle_stream(runs: DataFrame, key: str = "check", interval: str = "30 seconds", late: str = "1 minute", beats: DataFrame | None = None) -> DataFrame:
    """Runs of a check that are kept when it may run at most once per interval; start it with ``HOT_SETTINGS`` where checks are few."""
    return in_event_time(runs, [key], Throttle(width_us(interval)), late, beats)


class RuleStates(Machine):
    """Breaches of a rule by a series: pending, firing once held for its time, resolved."""

    columns = ("breach", "hold_us")
    outputs = "change string, since_us bigint, at_us bigint"
    start = (None, False)

    def step(self, state, row):
        (since, fired), (at, _, breach, hold) = state, row
        out = []
        if not breach:
            return self.start, [] if since is None else [("resolved", since, at)]
        if since is None:
            since, fired = at, False
            out.append(("pending", since, at))
        if not fired and at - since >= hold:
            fired = True
            out.append(("firing", since, at))
        return (since, fired), out


def alert_state_stream(samples: DataFrame, rules: DataFrame, late: str = "1 minute", beats: DataFrame | None = None) -> DataFrame:
    """Changes of every rule and series: pending, firing (held for its time), resolved."""
    matched = match_alert_rules(samples, rules)
    matched = matched.select("rule", "series", "ts", "seq", "breach", (F.col("hold_seconds") * 1_000_000).alias("hold_us"))
    return in_event_time(matched, ["rule", "series"], RuleStates(), late, beats)


class LastValue(Machine):
    """The latest value of a key, given out and forgotten when no other has come for the time to live."""

    start = (None,)

    def __init__(self, columns: dict[str, str], ttl_us: int):
        self.columns, self.ttl_us = tuple(columns), ttl_us
        ddl = [f"{c} {t}" for c, t in columns.items()]
        self.outputs = ", ".join([*ddl, "at_us bigint"])
        self.start = (None,) * (1 + len(columns))

    def step(self, state, row):
        return (row[0], *row[2:]), []

    def due(self, state):
        return None if state[0] is None else state[0] + self.ttl_us

    def on_due(self, state):
        return self.start, [(*state[1:], state[0])]


def expire_results_stream(results: DataFrame, ttl: str = "1 hour", late: str = "1 minute", beats: DataFrame | None = None) -> DataFrame:
    """Each task's last known result once it has been the last for the time to live: one row per task, or
    one per stretch of results if there is a longer pause between them."""
    kind = results.schema["success"].dataType.simpleString()
    out = in_event_time(results, ["task_id"], LastValue({"success": kind}, width_us(ttl)), late, beats)
    return out.select("task_id", "success", F.timestamp_micros("at_us").alias("ts"))


class First(Machine):
    """The first row of a key by time; others are dropped for as long as it is remembered."""

    start = (None,)

    def __init__(self, columns: dict[str, str], keep_us: int):
        self.columns, self.keep_us = tuple(columns), keep_us
        self.outputs = ", ".join([*[f"{c} {t}" for c, t in columns.items()], "at_us bigint", "seq bigint"])

    def step(self, state, row):
        return (state, []) if state[0] is not None else ((row[0],), [(*row[2:], row[0], row[1])])

    def due(self, state):
        return None if state[0] is None else state[0] + self.keep_us

    def on_due(self, state):
        return self.start, []


def dedupe_stream(
    events: DataFrame, keys: Sequence[str] = ("task_id",), late: str = "1 hour", remember: str = "1 day", beats: DataFrame | None = None
) -> DataFrame:
    """First row of an id by (ts, seq); others are dropped for as long as the id is remembered."""
    columns = {c: t for c, t in events.dtypes if c not in (*keys, "ts", "seq")}
    out = in_event_time(events, keys, First(columns, width_us(remember)), late, beats)
    return out.select(*keys, *columns, F.timestamp_micros("at_us").alias("ts"), "seq")
