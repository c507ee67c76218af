"""Bounded samples, the same whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def id_remainder(divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


LEAD = 48  # a 64-bit hash without its leading 16 bits


def lead_cut(counts: DataFrame, limit: int) -> int | None:
    """The last of the ordered ``lead`` values that the first ``limit`` rows reach; None if there are no more rows.

    ``counts`` is (lead, count), at most 65,536 rows."""
    total = 0
    for lead, n in sorted((r["lead"], r["count"]) for r in counts.collect()):
        total += n
        if total >= limit:
            return lead
    return None


def first_by_hash(rows: DataFrame, key: Column, limit: int, *then: str) -> DataFrame:
    """The first ``limit`` rows by a 64-bit hash, then by the columns ``then``.

    Rows are first counted by the leading bits of the hash, so a partition sends on only what can be among
    the first, not ``limit`` rows each. ``rows`` is read twice and should be a table or cheap to compute.
    """
    lead = F.shiftright(key, LEAD)
    cut = lead_cut(rows.groupBy(lead.alias("lead")).count(), limit)
    return (rows if cut is None else rows.filter(lead <= cut)).orderBy(key, *then).limit(limit)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int, values: list | None = None) -> DataFrame:
    """(doc_id, text, label, fold) of at most ``limit`` labelled documents of the allowed ids.

    Ids are taken in the order of a hash, so the sample is even over the table. Only the picked ids,
    at most ``limit`` of them, are broadcast. ``values`` draws the same number of ids per label value.
    ``fold`` is 0 to 3 and independent of the order.
    """
    rows = labels.select("doc_id", F.col(label).alias("label")).filter(allowed & F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    parts = [rows] if values is None else [rows.filter(F.col("label") == v) for v in values]
    picked = None
    for part in parts:
        part = first_by_hash(part, F.xxhash64("doc_id"), limit // len(parts), "doc_id")
        picked = part if picked is None else picked.unionByName(part)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).cast("int").alias("fold")
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "label", fold)
