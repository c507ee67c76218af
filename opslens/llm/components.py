"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from opslens.session import scratch_path


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links; nodes share a root exactly if links connect them.

    Each round maps every node to the neighbour of least hashed id (or itself) and joins links
    through that map, so nodes that are no such minimum vanish: a constant share of any path per round
    and a star within two. Rounds end when no link is left. Only links and maps are shuffled.
    Hashes order the nodes, so chains of rising ids are no worst case.
    """
    spark = links.sparkSession

    def saved(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.parquet(path)

    left = saved(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "links")
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("v", "u"))
        least = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v"))
        moves = saved(least.select(F.col("u").alias("node"), F.least(own, F.col("m"))["v"].alias("to")), "moves")
        if labels is None:
            labels = moves.select("node", F.col("to").alias("root"))
        else:
            hop = moves.select(F.col("node").alias("root"), "to")
            labels = labels.join(hop, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = saved(labels, "labels")
        first, second = moves.toDF("u", "fu"), moves.toDF("v", "fv")
        left = saved(left.join(first, "u").join(second, "v").select(F.col("fu").alias("u"), F.col("fv").alias("v")).filter("u <> v").distinct(), "links")
    if labels is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels


def smallest_member(labels: DataFrame) -> DataFrame:
    """(node, component_id): the smallest node of its component."""
    least = labels.groupBy("root").agg(F.min("node").alias("component_id"))
    return labels.join(least, "root").select("node", "component_id")
