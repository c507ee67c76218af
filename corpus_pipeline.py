"""Corpus preparation: stages that each take the documents the stage before them kept.

Order: toxic documents go, one document of each near-duplicate group stays, documents with benchmark
items go, personal data is redacted, and what is left is packed into sequences. All stages but the
last return the columns of ``documents``. Each stage's rows are written to the shared folder and read
again, so a lost executor never costs more than the stage at hand.

Defined results of all stages: null and empty texts stay until packing, where each is an end mark; extra
columns are kept until then; rows with a null id are documents like others, but no near duplicates of
any; an empty table gives an empty one; ties of scores fall on the side the operator's threshold names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.llm import decontaminate, ngram_join, packing, pii, toxicity
from opslens.llm.keyset import divided
from opslens.llm.sampling import id_remainder
from opslens.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; learned as in the query, on ids the hold-out leaves."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.train(docs, labels, id_remainder(4) != 2))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every component; documents without words all stay.

    Of rows that repeat an id and a text one stays. Different texts under one id share a fate: they go if
    one of them is in a component with a smaller id.
    """
    path = scratch_path(spark, "near")
    ngram_join.near_duplicates(docs).select("doc_id", "component_id").write.parquet(path)
    near = spark.read.parquet(path)
    goes = F.coalesce(F.col("component_id") != F.col("doc_id"), F.lit(False))
    found = near.filter(goes).select("doc_id")
    # ids alone are counted; where none repeats, the rest is an empty join
    twice = near.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    # texts go through a join only where the filters of ids leave open what becomes of them
    open_, stays = divided(docs, found.union(twice), ["doc_id"])
    open_ = divided(open_, near.filter(~goes).select("doc_id"), ["doc_id"])[0]
    kept = open_.join(found, "doc_id", "left_anti").select(docs.columns)
    repeated = kept.join(twice, "doc_id", "left_semi").select(docs.columns)
    words = F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))
    once = repeated.filter(words).dropDuplicates(["doc_id", "text"])
    single = kept.join(twice, "doc_id", "left_anti").select(docs.columns)
    return stays.unionByName(single).unionByName(repeated.filter(~words)).unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is verified."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs, pii.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]
# learned scores, shared passages and tokens are beyond SQL; tests/llm/test_pipeline.py checks each stage by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
