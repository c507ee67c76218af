"""Collects checked queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from checks.views import with_views
from opslens.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# all relative-to-now predicates are judged at this instant
AS_OF_TASKS = "1998-06-15 00:00:00"
AS_OF_EVENTS = "2024-01-20 00:00:00"
AS_OF_TASKS_US = 897_868_800_000_000
AS_OF_EVENTS_US = 1_705_708_800_000_000


def as_of_tasks() -> Column:
    return F.lit(AS_OF_TASKS).cast("timestamp")


def as_of_events() -> Column:
    return F.lit(AS_OF_EVENTS).cast("timestamp")


def us(name: str, out: str | None = None) -> Column:
    """Timestamp column as microseconds, so that both engines give the same whole number."""
    return F.unix_micros(name).alias(out or f"{name.removesuffix('_at')}_us")


def r(name: str, digits: int = 6) -> Column:
    """Rounded column; the tiny shift keeps exact halves from rounding differently per engine."""
    return F.round(F.col(name) + 1e-9, digits).alias(name)


def check(name: str, views: str = "", sql: str | None = None, recursive: bool = False):
    """Register the decorated query under ``name``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            configure(spark)
            return fn(spark, folder)

        run.__doc__ = fn.__doc__
        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            text = sql.replace("{as_of_tasks}", str(AS_OF_TASKS_US)).replace("{as_of_events}", str(AS_OF_EVENTS_US))
            ORACLES[name] = with_views(views, text, recursive)
        return fn

    return register
