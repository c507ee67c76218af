"""JSON text to variant values, whole text or nothing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strict_json(text: Column | str) -> Column:
    """The parsed value, or null unless the whole text is exactly one JSON value.

    The parser stops after the first complete value, so the text is read as the only element
    of an array: anything left over breaks the array or makes it longer.
    """
    col = F.col(text) if isinstance(text, str) else text
    values = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), col, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))
