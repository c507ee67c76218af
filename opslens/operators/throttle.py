"""Runs of a check that are kept when it may run at most once per interval."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from opslens.plans.folds import Fold, chunked_fold
from opslens.plans.ordered import time_chunk, width_us


class Throttle(Fold):
    """Keep a row if it is forced, the first, or one interval after the last kept row.

    Which rows of a run are kept depends on the row before it only through the first kept row
    of the run, which lies within one interval of the start (or is the first row after it).
    The summary lists these possible first rows with the last kept row each leads to.
    """

    columns = ("_at", "_forced")
    outputs = "kept boolean"

    def __init__(self, interval_us: int):
        self.interval = interval_us

    def empty(self):
        return [], []

    def absorb(self, summary, row):
        summary[0].append(row[0])
        summary[1].append(bool(row[1]))
        return summary

    def dump(self, summary):
        at, forced = summary
        n = len(at)
        last = [0] * n
        next_forced = n
        for i in range(n - 1, -1, -1):
            following = min(bisect_left(at, at[i] + self.interval, i + 1), next_forced)
            last[i] = last[following] if following < n else at[i]
            if forced[i]:
                next_forced = i
        starts = []
        for i in range(n):
            starts.append([at[i], last[i], forced[i]])
            if forced[i] or at[i] >= at[0] + self.interval:
                break
        return json.dumps(starts)

    def first_state(self):
        return "null"

    def advance(self, state, summary):
        kept = json.loads(state)
        for at, last, forced in json.loads(summary):
            if forced or kept is None or at - kept >= self.interval:
                return json.dumps(last)
        return state

    def load(self, state):
        return json.loads(state)

    def step(self, kept, row):
        at, forced = row
        take = bool(forced) or kept is None or at - kept >= self.interval
        return (at if take else kept), (take,)


def throttle(
    runs: DataFrame, keys: Sequence[str] = ("check",), interval: str = "30 seconds", forced: str | None = None, width: str = "1 hour"
) -> DataFrame:
    """Adds ``kept`` to every run of a check."""
    force = F.col(forced) if forced else F.lit(False)
    marked = runs.withColumns({"_at": F.unix_micros("ts"), "_forced": force})
    out = chunked_fold(marked, keys, ["ts", "seq"], time_chunk("ts", width), Throttle(width_us(interval)))
    return out.drop("_at", "_forced")
