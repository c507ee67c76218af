"""Keyed stores: hits since the last store, eviction candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslens.plans.ordered import first_n


def memory_access_counts(ops: DataFrame) -> DataFrame:
    """Per memory and key: hits since its last store, and misses before its first.

    Aggregates only: the last store of each key, then the reads after it.
    """
    keys = ["memory_id", "key"]
    stores = ops.where(F.col("op") == "store").groupBy(*keys).agg(F.max("seq").alias("_last"), F.min("seq").alias("_first"))
    reads = ops.where(F.col("op") == "retrieve").join(stores, keys, "left")
    counted = reads.groupBy(*keys).agg(
        F.count_if(F.col("seq") > F.col("_last")).alias("hits"),
        F.count_if(F.col("_first").isNull() | (F.col("seq") < F.col("_first"))).alias("misses"),
    )
    out = stores.select(*keys, F.lit(True).alias("stored")).join(counted, keys, "full_outer")
    return out.select(
        *keys,
        F.coalesce("stored", F.lit(False)).alias("stored"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("misses", F.lit(0)).alias("misses"),
    )


def eviction_candidates(ops: DataFrame, k: int) -> DataFrame:
    """The k least accessed stored keys of each memory, oldest first on ties."""
    last = ops.where(F.col("op") == "store").groupBy("memory_id", "key").agg(F.max("seq").alias("stored_seq"))
    counted = memory_access_counts(ops).where("stored").join(last, ["memory_id", "key"])
    return first_n(counted, ["memory_id"], ["hits", "stored_seq"], k, rank="rank")
