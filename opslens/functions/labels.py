"""Label maps and number text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def merge_labels(base: Column | str, extra: Column | str) -> Column:
    """Union of two label maps; the right-hand side wins."""
    left = F.col(base) if isinstance(base, str) else base
    right = F.col(extra) if isinstance(extra, str) else extra
    return F.map_zip_with(left, right, lambda _k, x, y: F.coalesce(y, x))


def format_labels(labels: Column | str) -> Column:
    """``{k="v",...}`` with sorted keys, or the empty string for no labels."""
    col = F.col(labels) if isinstance(labels, str) else labels
    entries = F.sort_array(F.map_entries(col))
    pairs = F.transform(entries, lambda e: F.concat(e.key, F.lit('="'), e.value, F.lit('"')))
    return F.when(F.size(col) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")


def number_text(value: Column) -> Column:
    """Plain decimal text of a double: ``3.0``, ``12.5``; no exponent for large values."""
    whole = F.concat(value.cast("bigint").cast("string"), F.lit(".0"))
    long = F.rtrim(F.format_string("%.10f", value), F.lit("0"))
    size = F.abs(value)
    return (
        F.when(F.isnan(value) | (size == float("inf")), value.cast("string"))
        .when((size < 1e15) & (value == F.floor(value)), whole)
        .when((size >= 1e7) | (size < 1e-3), long)
        .otherwise(value.cast("string"))
    )
