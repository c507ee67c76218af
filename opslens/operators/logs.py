"""Timed operations and context in log records."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from opslens.operators.stats import metric_summary
from opslens.plans.folds import Fold, chunked_fold
from opslens.plans.ordered import time_chunk


def performance_records(logs: DataFrame) -> DataFrame:
    """Records of finished operations with their typed fields."""
    extra = F.col("extra")

    def field(name: str):
        return F.try_element_at(extra, F.lit(name))

    out = logs.where(field("duration_ms").isNotNull())
    return out.select(
        "timestamp",
        "ts",
        "logger",
        "message",
        "thread_id",
        F.try_element_at("context", F.lit("operation")).alias("operation"),
        F.try_element_at("context", F.lit("cognitive_layer")).alias("cognitive_layer"),
        field("duration_ms").try_cast("double").alias("duration_ms"),
        field("success").try_cast("boolean").alias("success"),
        field("error").alias("error"),
        F.coalesce(field("performance_metric").try_cast("boolean"), F.lit(False)).alias("performance_metric"),
    )


def operation_stats(records: DataFrame, keys: Sequence[str] = ("operation",)) -> DataFrame:
    """Runs, failures and duration summary per operation."""
    summary = metric_summary(records, keys, "duration_ms", {"failures": ~F.col("success")})
    return summary.select(
        *keys,
        F.col("count").alias("runs"),
        "failures",
        "mean",
        "median",
        "p95",
        "p99",
        (F.col("failures") / F.col("count")).alias("failure_ratio"),
    )


class ContextStack(Fold):
    """Nested contexts of a thread: entering merges over the outer one, leaving restores it.

    A run of rows is summarised as how many outer contexts it leaves and what it enters.
    """

    columns = ("kind", "context")
    outputs = "merged string, depth int"

    def empty(self):
        return [0, []]

    def absorb(self, summary, row):
        kind, text = row
        if kind == "enter":
            summary[1].append(json.loads(text or "{}"))
        elif kind == "exit":
            if summary[1]:
                summary[1].pop()
            else:
                summary[0] += 1
        return summary

    def dump(self, summary):
        return json.dumps(summary)

    def first_state(self):
        return "[]"

    def advance(self, state, summary):
        stack = json.loads(state)
        left, entered = json.loads(summary)
        stack = stack[: max(len(stack) - left, 0)]
        for context in entered:
            stack.append({**(stack[-1] if stack else {}), **context})
        return json.dumps(stack)

    def load(self, state):
        return json.loads(state)

    def step(self, stack, row):
        kind, text = row
        if kind == "enter":
            stack.append({**(stack[-1] if stack else {}), **json.loads(text or "{}")})
        elif kind == "exit" and stack:
            stack.pop()
        top = json.dumps(stack[-1], sort_keys=True) if stack and kind == "log" else None
        return stack, (top, len(stack))


def enrich_with_context(rows: DataFrame, keys: Sequence[str] = ("thread_id",), width: str = "1 hour") -> DataFrame:
    """Log rows with the merged context that was active on their thread.

    ``rows`` holds ``enter``, ``exit`` and ``log`` rows (``kind``) with ``ts, seq`` and the JSON
    text of the entered ``context``.
    """
    folded = chunked_fold(rows, keys, ["ts", "seq"], time_chunk("ts", width), ContextStack())
    out = folded.where(F.col("kind") == "log").drop("kind", "context")
    return out.withColumn("context", F.from_json("merged", "map<string,string>")).drop("merged")
