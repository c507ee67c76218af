"""Secrets in texts: wide candidates, and a random forest that takes the false positives out.

A candidate is a run of 16 or more characters of ``[A-Za-z0-9_+/=.-]``, or of 8 or more after a sign of
assignment or a credential word; digits are not asked for. The forest sees its
length, character classes and transitions between them, how much of it dictionary words cover, path
traits, and the words beside it. In ``NAME=value`` the value is the finding and the name stands before
it. The forest learns from labelled findings (doc_id, start, label); where a corpus has none,
``cue_labels`` names as secret what is assigned to a credential word or follows an authorization
scheme, and as other what tells by its form or by another cue; the rest teaches nothing. Built-in
functions and Spark's own forest only.

Defined results: null, empty and candidate-free texts give no row; repeated rows give their own rows
each; extra columns are ignored; without labels of both kinds nothing can be told apart, and every
candidate scores the share of secrets among the labels (0 without labels); an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opslens.session import scratch_path

# a credential word and what may stand between it and its value
CREDENTIAL = r"(?i:token|secret|passw|passphrase|pwd|api.?key|access.?key|private|credential|auth|bearer|basic)\w{0,20}[\"'`]?[\x20\x09=:>]{1,4}[\"'`]?"
RUN = r"[A-Za-z0-9_+/=.\-]"
CANDIDATE = (
    rf"(?<!{RUN})(?=[_+/=.\-]*+[A-Za-z0-9])(?:{RUN}{{16,}}+"
    rf"|(?={RUN}{{8}})(?:(?<=[=:][\x20\x09]{{0,8}}[\"'`]?)|(?<={CREDENTIAL})|(?=[A-Za-z0-9_+/.\-]{{0,7}}=[^=](?<={RUN}){RUN}{{7}})){RUN}{{8,}}+)"
)
# up to the last = that a value of 8 characters follows; padding stays with the value
NAME = r"^(.*=)(?=[^=].{7})"
WORD_SPACE = r"[\x20\x09-\x0D]+"
SECRET_CUE = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private|credential|auth(?!or(?!i[sz]))|bearer)"
OTHER_CUE = r"(?i)(commit|sha|md5|digest|checksum|uuid|version|revision|build|isbn|card|account|order|invoice)"
IDENTIFIER = r"^[A-Za-z_][A-Za-z_.\-]*$"
ASSIGNS = r"^[\"'`]?[\x20\x09]*[=:]"
PLAIN = r"^[A-Za-z]?[a-z]+\.?$"  # a word as prose has it
# forms that tell: numbers, words, paths and hosts with an extension
# no group is repeated here: the engine goes one call deeper for each turn of one
OTHER_FORM = r"^([0-9./\-]+|[A-Za-z]?[a-z]+\.?|[A-Za-z0-9_\-./]*\.[A-Za-z]{2,5})$"
SAMPLE = 20_000  # labelled findings to learn from
DICTIONARY = 2_000  # words
TREES, DEPTH = 30, 6
FEATURES = [
    "n_chars", "n_digits", "n_upper", "n_lower", "n_marks", "n_turns", "n_distinct", "is_hex", "covered",
    "n_slashes", "n_dots", "has_extension", "cue_before", "other_before", "assigned", "quoted", "word_before", "word_after", "is_name",
]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, row, start, end, finding, before, after): one row per candidate; offsets in code points.

    ``before`` and ``after`` are up to 60 characters beside it. ``row`` tells repeated documents apart.
    """
    rows = docs.select("doc_id", "text").filter(F.col("text").rlike(CANDIDATE)).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("doc_id", "row", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("hit"), F.split("text", CANDIDATE, -1).alias("gap"))
    # what stands beside a candidate may be candidates as well
    each = rows.select(
        "doc_id",
        "row",
        F.posexplode(
            F.expr(
                f"""transform(hit, (h, i) -> struct(
                    regexp_replace(h, r'{NAME}', '') AS finding,
                    length(gap[i]) AS skipped,
                    length(h) AS n_hit,
                    right(concat_ws('', right(get(gap, i - 2), 60), right(get(hit, i - 2), 60), right(get(gap, i - 1), 60), right(get(hit, i - 1), 60), gap[i], regexp_extract(h, r'{NAME}', 1)), 60) AS before,
                    left(concat_ws('', gap[i + 1], left(get(hit, i + 1), 60)), 60) AS after))"""
            )
        ).alias("at", "c"),
    ).select("doc_id", "row", "at", "c.*")
    # only candidate rows are shuffled; a partition is one document
    total = "sum(skipped + n_hit) OVER (PARTITION BY row ORDER BY at)"
    out = each.withColumn("end", F.expr(total).cast("long")).withColumn("start", F.col("end") - F.length("finding"))
    return out.select("doc_id", "row", "start", "end", "finding", "before", "after")


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of at least three letters over all documents; counts are summed before the shuffle."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b[a-z]{3,}\b"), F.lit(0))).alias("word"))
    return [r.word for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size).collect()]


def _count(pattern: str) -> Column:
    return F.regexp_count("finding", F.lit(pattern)).cast("double")


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    """Adds the forest's features to candidate rows."""
    known = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    runs = F.regexp_extract_all(F.lower("finding"), F.lit(r"[a-z]{3,}"), F.lit(0))
    covered = F.aggregate(F.filter(runs, lambda w: F.array_contains(known, w)), F.lit(0), lambda a, w: a + F.length(w)) / F.length("finding")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    # the line's last three words: a credential word, a sign of assignment and a quote
    near = F.regexp_extract("before", r"((?:[^\x20\x09-\x0D]*[\x20\x09]*){2}[^\x20\x09-\x0D]*)$", 1)
    return found.select(
        "*",
        F.length("finding").cast("double").alias("n_chars"),
        _count(r"[0-9]").alias("n_digits"),
        _count(r"[A-Z]").alias("n_upper"),
        _count(r"[a-z]").alias("n_lower"),
        _count(r"[_+/=.\-]").alias("n_marks"),
        _count(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])").alias("n_turns"),
        F.size(F.array_distinct(F.split("finding", ""))).cast("double").alias("n_distinct"),
        flag(F.col("finding").rlike(r"^([0-9a-f]+|[0-9A-F]+)$")).alias("is_hex"),
        covered.cast("double").alias("covered"),
        _count("/").alias("n_slashes"),
        _count(r"\.").alias("n_dots"),
        flag(F.col("finding").rlike(r"\.[A-Za-z]{2,5}$")).alias("has_extension"),
        flag(near.rlike(SECRET_CUE)).alias("cue_before"),
        flag(near.rlike(OTHER_CUE)).alias("other_before"),
        flag(F.col("before").rlike(r"[=:][\x20]*[\"'`]?$")).alias("assigned"),
        flag(F.col("before").rlike(r"[\"'`]$")).alias("quoted"),
        flag(F.col("before").rlike(r"\p{L}[\x20\x09-\x0D]*$")).alias("word_before"),
        flag(F.col("after").rlike(r"^[\x20\x09-\x0D]*\p{L}")).alias("word_after"),
        flag(F.col("finding").rlike(IDENTIFIER) & F.col("after").rlike(ASSIGNS)).alias("is_name"),
    )


def cue_labels(found: DataFrame) -> DataFrame:
    """(doc_id, start, label) for findings whose surroundings and form tell; uncertain ones are left out.

    Secret is what is assigned to a credential word or follows an authorization scheme. Other is what
    stands in running text and is a number, a word, a path or a host; what follows another cue or
    an at-sign; and the name in an assignment. A word after ``token: `` may be either.
    """
    line = F.regexp_extract("before", r"([^\x0A]*)$", 1)
    plain, cue = F.col("finding").rlike(PLAIN), line.rlike(SECRET_CUE)
    assigned = line.rlike(SECRET_CUE + r"[\x20\w\"']{0,20}[=:>]{1,2}[\x20\x09]*[\"'`]?$")
    value = ~plain | line.rlike(r"[\"'`=]$|=[\x20\x09]+$")
    scheme = line.rlike(r"(?i)\bauthorization[\"']?[\x20]*[=:][\x20]*[\"'`]?\w+[\x20]+$") | (line.rlike(r"(?i)\b(bearer|basic)[\x20]+[\"'`]?$") & ~plain)
    name = F.col("finding").rlike(IDENTIFIER) & F.col("after").rlike(ASSIGNS)
    running = ~line.rlike(r"(?i)\bbasic[\x20]+$") & F.col("before").rlike(r"(^|\x0A|\p{L}[.,;:!?]?[\x20])[\x20]*$") & F.col("finding").rlike(OTHER_FORM)
    other = F.col("before").rlike("@$") | name | (~cue & (line.rlike(OTHER_CUE) | running))
    label = F.when((assigned & value & ~name) | scheme, 1).when(other & ~assigned, 0)
    return found.select("doc_id", "start", label.alias("label")).filter("label IS NOT NULL")


def scan(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, end, finding, score, is_secret) of every candidate.

    ``labels`` holds labelled findings; at most ``SAMPLE`` of them, in hash order, are learned from.
    """
    # texts are read once; labels, training and scoring read the candidates' features
    path = scratch_path(docs.sparkSession, "candidates")
    with_features(candidates(docs), dictionary(docs)).write.parquet(path)
    found = docs.sparkSession.read.parquet(path)
    labels = cue_labels(found) if labels is None else labels
    once = labels.filter("label IS NOT NULL").groupBy("doc_id", "start").agg(F.max("label").cast("double").alias("label"))
    known = found.join(once, ["doc_id", "start"]).orderBy(F.xxhash64("finding", "doc_id", "start")).limit(SAMPLE)
    kinds = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(kinds) < 2:
        scored = found.withColumn("score", F.lit(1.0 if kinds.get(1.0) else 0.0))
    else:
        join = VectorAssembler(inputCols=FEATURES, outputCol="features")
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=7)
        model = forest.fit(join.transform(known))
        scored = model.transform(join.transform(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "start", "end", "finding", "score", (F.col("score") >= threshold).alias("is_secret"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings judged to be secrets, by place and hash; the secret itself is not given out."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("is_secret")
    return out.select("doc_id", "start", "end", F.sha2(F.col("finding").cast("binary"), 256).alias("finding_sha256"), "score")


QUERIES = {"op6_secret_scan": op6_secret_scan}
