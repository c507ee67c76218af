"""Sets of keys as bitmaps, so that rows whose key is surely not among them need not go through a join.

Each key sets one bit by its hash. The bits are built in pages by Spark and broadcast; their number follows
that of the keys, ``BITS`` each, up to ``MOST`` (32 MB). Beyond ``MOST / BITS`` keys (8 million) the filter lets more
rows through: about one in nine of those it could stop at 32 million keys. It never stops a row whose key is in the set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

BITS = 32
LEAST, MOST = 1 << 18, 1 << 28
# bits of one page, as bitmap_construct_agg makes them
PAGE = 1 << 15


def _place(by: Sequence[str], size: int) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(size))


def divided(rows: DataFrame, keys: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that may have a key of ``keys`` in the columns ``by``, and rows that have none.

    ``keys`` is counted first and read again, so it should be a written table. Both sides need the same types.
    """
    size = min(max(LEAST, 1 << (BITS * keys.count()).bit_length()), MOST)
    place = _place(by, size)
    pages = (
        keys.select((place / PAGE).cast("int").alias("_page"), (place % PAGE).alias("_bit"))
        .repartition("_page")
        .groupBy("_page")
        .agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    )
    placed = rows.withColumns({"_page": (place / PAGE).cast("int"), "_bit": (place % PAGE).cast("int")}).join(F.broadcast(pages), "_page", "left")
    byte = F.expr("cast(conv(hex(substring(_bits, _bit div 8 + 1, 1)), 16, 10) AS int)")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, _bit % 8)")) != 0, F.lit(False))
    return placed.filter(hit).select(*rows.columns), placed.filter(~hit).select(*rows.columns)
