"""Exact order statistics per key without sorting a key in one task.

Doubles have 64-bit numbers in their order. A wanted rank is found by descending through the leading
bits of these numbers, ``BITS`` at a time: the rows of a key are counted by prefix, and only the prefix
that holds the rank is looked at more closely. No window has more than ``2 ** BITS`` rows, whatever the
number and spread of the values, and nothing runs before the result is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BITS = 11
# bits that the first pass drops; the second counts whole values
FINE = 64 - 2 * BITS
# size of the row filter of the second pass: 8 kB, whatever the number of keys
FILTER_WORDS = 1024


def value_order(column: str) -> Column:
    """Number of a double in the order of doubles; zeros are 0, NaN comes after infinity.

    The logarithm only guesses the exponent, two comparisons put it right; the rest is scaling by
    powers of two, which is exact.
    """
    size, guess = f"abs({column})", f"floor(log2(abs({column})))"
    exponent = f"({guess} + int({size} >= pow(2D, {guess} + 1)) - int({size} < pow(2D, {guess})))"
    normal = f"({exponent} + 1023) * {2**52} + bigint(({size} / pow(2D, {exponent}) - 1) * {2**52}D)"
    # below the smallest power of two with a full mantissa, steps are even
    small = f"bigint({size} * pow(2D, 537) * pow(2D, 537))"
    return F.expr(
        f"CASE WHEN isnan({column}) THEN bigint({2047 * 2**52 + 1}) WHEN {column} = 0 THEN bigint(0)"
        f" WHEN {size} = double('infinity') THEN bigint(sign({column})) * bigint({2047 * 2**52})"
        f" WHEN {size} < {2.0**-1022!r}D THEN bigint(sign({column})) * {small}"
        f" ELSE bigint(sign({column})) * ({normal}) END"
    )


def _prefix(column: str, dropped: int) -> Column:
    return F.shiftright(column, dropped)


def _wanted(skip: str, upto: str) -> Column:
    """The wanted ranks behind ``skip`` and up to ``upto``, counted from ``skip``."""
    inside = f"filter(_wants, w -> w.rank > {skip} AND w.rank <= {upto})"
    return F.expr(f"transform({inside}, w -> named_struct('_name', w._name, 'rank', w.rank - {skip}))")


def _descend(targets: DataFrame, counted: DataFrame, outer: int, inner: int) -> DataFrame:
    """One step: targets ``(_k, _at, _stats, _wants)`` at prefixes with ``outer`` dropped bits, to prefixes
    with ``inner`` dropped bits. ``counted`` has ``_k, _o, _v, _n``."""
    level = counted.groupBy("_k", _prefix("_o", inner).alias("_next")).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"))
    found = targets.drop("_lo").join(level.withColumn("_at", _prefix("_next", outer - inner)), ["_k", "_at"])
    running = W.partitionBy("_k", "_at").orderBy("_next").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = found.withColumn("_to", F.sum("_n").over(running)).withColumn("_wants", _wanted("(_to - _n)", "_to"))
    return found.where(F.size("_wants") > 0).select("_k", F.col("_next").alias("_at"), "_stats", "_wants", "_lo")


def _filter(targets: DataFrame) -> Column:
    """Bits of the hashed targets, as an array of ``FILTER_WORDS`` numbers."""
    word, bit = _slot("_k", "_at")
    bits = targets.select(word.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.expr("bit_or(shiftleft(bigint(1), _b))").alias("_m"))
    words = targets.sparkSession.range(FILTER_WORDS, numPartitions=1).select(F.col("id").alias("_w"))
    rows = words.join(bits, "_w", "left").agg(F.sort_array(F.collect_list(F.struct("_w", F.coalesce("_m", F.lit(0)).alias("_m")))).alias("_all"))
    return rows.select(F.expr("transform(_all, x -> x._m)")).scalar()


def _slot(*columns: str) -> tuple[Column, Column]:
    """Word and bit of a row in the filter of the second pass."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(64 * FILTER_WORDS))
    return F.floor(slot / 64), F.pmod(slot, F.lit(64)).cast("int")


def order_statistics(
    df: DataFrame, keys: Sequence[str], value: Column, ranks: dict[str, str], counts: dict[str, Column] | None = None
) -> DataFrame:
    """One row per key: ``n, total, low, high, m2`` (sum of squared deviations) and the value
    at every wanted 1-based rank. ``ranks`` maps output names to SQL over ``n``; ``counts`` adds
    numbers of rows that meet a condition. Null values are left out; null keys are keys.

    The first pass counts rows by key and 22 leading bits. Ranks whose cell has a single value are
    found by that. For the others a second pass counts the values of their cells; which rows it
    shuffles is decided by a filter of fixed size, so no side has to be small enough to be sent around.
    """
    keys, counts = list(keys), counts or {}
    marks = [F.when(c, 1).otherwise(0).alias(f"_is_{name}") for name, c in counts.items()]
    # inside a struct null equals null, in groups and in joins
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    base = df.select(key.alias("_k"), value.cast("double").alias("_v"), *marks).where(F.col("_v").isNotNull())
    # never null, or each step would push its own null check below the counts
    base = base.withColumn("_o", F.coalesce(value_order("_v"), F.lit(0)))
    cells = base.groupBy("_k", _prefix("_o", FINE).alias("_at")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_v").alias("_s"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.var_pop("_v").alias("_var"),
        *[F.sum(f"_is_{name}").alias(f"_is_{name}") for name in counts],
    )
    # always true: every use below needs all columns then, so all of them read one exchange
    used = ["_s", "_lo", "_hi", "_var", *[f"_is_{name}" for name in counts]]
    cells = cells.where(" AND ".join(f"{c} IS NOT NULL" for c in used)).withColumn("_top", _prefix("_at", BITS))
    group = W.partitionBy("_k", "_top")
    upto = group.orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    gap = F.col("_s") / F.col("_n") - F.sum("_s").over(group) / F.sum("_n").over(group)
    cells = cells.withColumns({"_to": F.sum("_n").over(upto), "_m2": (F.col("_var") + gap * gap) * F.col("_n")})
    tops = cells.groupBy("_k", "_top").agg(
        *[F.sum(c).alias(c) for c in ("_n", "_s", "_m2", *[f"_is_{name}" for name in counts])],
        F.min("_lo").alias("_lo"),
        F.max("_hi").alias("_hi"),
    )
    whole = W.partitionBy("_k")
    upto = whole.orderBy("_top").rowsBetween(W.unboundedPreceding, W.currentRow)
    tops = tops.withColumns(
        {
            "n": F.sum("_n").over(whole),
            "total": F.sum("_s").over(whole),
            "low": F.min("_lo").over(whole),
            "high": F.max("_hi").over(whole),
            "_to": F.sum("_n").over(upto),
            **{name: F.sum(f"_is_{name}").over(whole) for name in counts},
        }
    )
    gap = F.col("_s") / F.col("_n") - F.col("total") / F.col("n")
    tops = tops.withColumn("m2", F.sum(F.col("_m2") + gap * gap * F.col("_n")).over(whole))
    stats, names = ["n", "total", "low", "high", "m2", *counts], list(ranks)
    each = ", ".join(f"named_struct('_name', '{k}', 'rank', bigint({ranks[k]}))" for k in names)
    targets = tops.withColumn("_wants", F.expr(f"array({each})")).withColumn("_wants", _wanted("(_to - _n)", "_to"))
    targets = targets.where(F.size("_wants") > 0).select("_k", "_top", F.struct(*stats).alias("_stats"), "_wants")
    targets = targets.join(cells.select("_k", "_top", "_at", "_n", "_to", "_lo", "_hi"), ["_k", "_top"])
    targets = targets.withColumn("_wants", _wanted("(_to - _n)", "_to")).where(F.size("_wants") > 0)
    mixed = targets.where(~(F.col("_lo") == F.col("_hi"))).select("_k", "_at", "_stats", "_wants")
    word, bit = _slot("_k", "_at")
    near = base.select("_k", "_v", "_o", _prefix("_o", FINE).alias("_at"))
    # the partition's number keeps the filter above the projection, where the value is computed once
    near = near.withColumns({"_w": word.cast("int"), "_b": bit, "_bits": _filter(mixed), "_part": F.spark_partition_id()})
    near = near.where("shiftright(_bits[_w], _b) & 1 = 1 AND _part >= 0")
    counted = near.groupBy("_k", "_o", "_v").agg(F.count(F.lit(1)).alias("_n"))
    steps = list(range(FINE, 0, -BITS)) + [0]
    for outer, inner in zip(steps, steps[1:]):
        mixed = _descend(mixed, counted, outer, inner)
    found = [targets.where("_lo = _hi"), mixed]
    picked = [f.select("_k", "_stats", F.expr("inline(transform(_wants, w -> named_struct('_name', w._name, '_x', _lo)))")) for f in found]
    out = (
        picked[0]
        .unionByName(picked[1])
        .groupBy("_k")
        .agg(
            F.first("_stats").alias("_stats"),
            *[F.expr(f"max(CASE WHEN _name = '{k}' THEN _x END)").alias(k) for k in names],
        )
    )
    return out.select(*[F.col("_k")[k].alias(k) for k in keys], "_stats.*", *names)


def exclusive_ranks(prefix: str, i: int, q: int) -> dict[str, str]:
    """Ranks that the exclusive quantile i/q of n values interpolates between."""
    j = _exclusive_j(i, q)
    return {f"{prefix}_a": j, f"{prefix}_b": f"least({j} + 1, n)"}


def _exclusive_j(i: int, q: int) -> str:
    return f"greatest(1, least({i} * (n + 1) div {q}, n - 1))"


def exclusive_value(prefix: str, i: int, q: int) -> Column:
    """Exclusive-method quantile i/q from the two picked values; may exceed the maximum."""
    d = f"({i} * (n + 1) - {_exclusive_j(i, q)} * {q})"
    return F.expr(f"CASE WHEN n = 1 THEN {prefix}_a ELSE ({prefix}_a * ({q} - {d}) + {prefix}_b * {d}) / {q} END")
