"""Ordered computations over keys of any size.

A plain window over ``partitionBy(key)`` sends all rows of a key to one task. The functions
here split the order of each key into chunks, aggregate each chunk (with map-side combine),
carry the aggregates forward over the small chunk table and finish inside each chunk. A key
that holds a third of all rows is then spread over as many tasks as it has chunks.

There is one plan for inputs of any size. What a chunk gets from before stands as one extra row at
its head, so nothing is joined: null keys and null chunks are groups like any other, as in a window.

``chunk`` is one column or a list of columns, ascending with nulls first, that coarsen ``order``: if a row
sorts before another one, its chunk must not be larger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

UNIT_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}


def width_us(width: str) -> int:
    """Microseconds of a width such as ``'1 day'`` or ``'5 minutes'``."""
    amount, unit = width.split()
    return int(amount) * UNIT_US[unit.rstrip("s")]


def time_chunk(ts: Column | str, width: str = "1 hour") -> Column:
    """Whole number of widths since the epoch."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col) / F.lit(width_us(width)))


def number_chunk(value: Column | str, width: int) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.floor(col / F.lit(width))


def _chunked(df: DataFrame, chunk) -> tuple[DataFrame, list[str]]:
    chunks = list(chunk) if isinstance(chunk, (list, tuple)) else [chunk]
    names = [f"_chunk{i}" for i in range(len(chunks))]
    return df.withColumns(dict(zip(names, chunks))), names


def _before(keys: Sequence[str], names: Sequence[str]):
    return W.partitionBy(*keys).orderBy(*names).rowsBetween(W.unboundedPreceding, -1)


def _headed(base: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows with ``_mark`` 1, and each chunk's carry row with ``_mark`` 0."""
    return base.withColumn("_mark", F.lit(1)).unionByName(carry.withColumn("_mark", F.lit(0)), allowMissingColumns=True)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, value: Column, chunk, out: str) -> DataFrame:
    """Sum of ``value`` over all rows up to and including this one, per key."""
    keys = list(keys)
    base, names = _chunked(df.withColumn("_v", value), chunk)
    part = keys + names
    carry = (
        base.groupBy(*part)
        .agg(F.sum("_v").alias("_t"))
        .select(*part, F.coalesce(F.sum("_t").over(_before(keys, names)), F.lit(0)).alias("_v"))
    )
    total = F.sum("_v").over(W.partitionBy(*part).orderBy("_mark", *order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return _headed(base, carry).withColumn(out, total).where("_mark = 1").drop("_v", "_mark", *names)


def position(df: DataFrame, keys: Sequence[str], order: Sequence, chunk, out: str) -> DataFrame:
    """1-based rank of the row in its key, like ``row_number``."""
    keys = list(keys)
    base, names = _chunked(df, chunk)
    part = keys + names
    carry = (
        base.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_t"))
        .select(*part, F.coalesce(F.sum("_t").over(_before(keys, names)), F.lit(0)).alias("_n"))
    )
    headed = _headed(base.withColumn("_n", F.lit(1).cast("bigint")), carry)
    count = F.sum("_n").over(W.partitionBy(*part).orderBy("_mark", *order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return headed.withColumn(out, count.cast("bigint")).where("_mark = 1").drop("_n", "_mark", *names)


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    chunk,
    out: str,
    inclusive: bool = False,
) -> DataFrame:
    """Latest non-null ``value`` of an earlier row (or this one, if inclusive), per key.

    ``order`` is a list of column names, ascending, unique within the key.
    """
    keys = list(keys)
    last = 0 if inclusive else -1
    base, names = _chunked(df, chunk)
    part = keys + names
    at = F.when(F.col("_v").isNotNull(), F.struct(*order))
    carry = (
        base.withColumn("_v", value)
        .groupBy(*part)
        .agg(F.max_by("_v", at).alias("_t"))
        .select(*part, F.last("_t", ignorenulls=True).over(_before(keys, names)).alias("_t"))
    )
    # a row's own value is taken behind the exchange, so that its columns do not travel twice
    headed = _headed(base, carry).repartition(*part).withColumn("_v", F.when(F.col("_mark") == 0, F.col("_t")).otherwise(value))
    frame = W.partitionBy(*part).orderBy("_mark", *order).rowsBetween(W.unboundedPreceding, last)
    latest = F.last("_v", ignorenulls=True).over(frame)
    return headed.withColumn(out, latest).where("_mark = 1").drop("_v", "_t", "_mark", *names)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], chunk, out: str) -> DataFrame:
    """Struct of ``columns`` of the preceding row (null on the first), like ``lag``."""
    return last_before(df, keys, order, F.struct(*columns), chunk, out)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, rank: str = "rn", fan_in: int = 64) -> DataFrame:
    """The first ``n`` rows of each key by ``order``, with their rank.

    Works as a tree: every map task keeps n rows of a key, ``fan_in`` groups of tasks keep n
    each, and only those reach the task that finishes the key.
    """
    keys = list(keys)
    final = W.partitionBy(*keys).orderBy(*order)
    grouped = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    partial = (
        grouped.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*order)))
        .where(F.col("_rn") <= n)
        .drop("_rn", "_salt")
    )
    return partial.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= n)


def first_row(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` of each key; aggregates on the map side."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def last_row(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the largest ``order`` of each key; aggregates on the map side."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)
