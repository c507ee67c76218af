"""Removal of long repeated word spans by de Bruijn compaction.

Every window of ``window`` consecutive words is an edge of a de Bruijn graph (from its first to its
last ``window - 1`` words). Edges are never listed one by one: consecutive windows of a document
that share the same least ``anchor``-gram form one path, and a path is one row. Paths are compacted
with Spark joins: a path whose whole word sequence recurs is one node-to-node path without branches,
so one row stands for all of its windows. Only where one anchor leads to several different paths
(a branching place) are the paths taken apart into single edges, once per distinct path. Covered
spans come back with source coordinates, are joined into maximal spans, and the words they cover
are removed.

What cannot match does not travel: paths whose anchor and single windows that stand in one document only, and
texts without branching paths or without spans, are left out of the joins by filters of bounded size
(``keyset``). The joins behind them are exact, so what a filter lets through too much costs time only.

Two windows count as equal if two independent 64-bit hashes agree, two paths if an independent hash of each
agrees besides that of their least n-gram, 64 bits each, and their lengths.

Defined results: null or empty texts and texts shorter than a window lose nothing; of equal
documents the one with the smallest id keeps its words; ids may be of any ordered type; rows that repeat
an id are rows of their own, told apart by a hash of their text, and never lose words to one another
(only a smaller id is a source); rows with a null id keep their words and are no source; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.llm import keyset
from opslens.llm.textnum import Spans, chunks, signed, split_words
from opslens.session import scratch_path

WINDOW = 50
ANCHOR = 12
SALTS = 16


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value among ``width`` values from each position on."""
    at = np.arange(len(values))
    have = 1
    while have < width:
        step = min(have, width - have)
        n = len(at) - step
        if n <= 0:
            return at[:0]
        left, right = at[:n], at[step : step + n]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at


def _paths(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words = split_words(part.column("text"))
            start, first = words.windows(window)
            if not len(start):
                continue
            one, two = words.hashes(0), words.hashes(1)
            spans = Spans(one, 0)
            at = np.arange(len(one) - anchor + 1)
            grams = spans(at, at + anchor)
            least = _least(grams, window - anchor + 1)[start]
            begins = np.ones(len(start), bool)
            begins[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
            begins[first[:-1][first[:-1] < len(start)]] = True
            head = np.flatnonzero(begins)
            n = np.diff(np.append(head, len(start)))
            lo = start[head]
            hi = lo + n - 1 + window
            doc = np.repeat(np.arange(len(words)), np.diff(first))[head]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(doc)),
                    part.column("row").take(pa.array(doc)),
                    signed(grams[least[head]]),
                    signed(Spans(two, 1)(lo, hi)),
                    pa.array((lo - words.first[doc]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                ],
                ["doc_id", "row", "anchor", "path", "lo", "n"],
            )


def _edges(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Single windows of the paths listed for each document."""
    for batch in batches:
        for part in chunks(batch):
            words = split_words(part.column("text"))
            listed = part.column("paths")
            count = np.diff(listed.offsets.to_numpy())
            flat = listed.flatten()
            n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(words)), count)
            lo = flat.field("lo").to_numpy(zero_copy_only=False) + words.first[doc]
            reps = np.repeat(np.arange(len(n)), n)
            at = lo[reps] + np.arange(len(reps)) - np.repeat(np.cumsum(n) - n, n)
            owner = doc[reps]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(owner)),
                    part.column("row").take(pa.array(owner)),
                    signed(Spans(words.hashes(0), 0)(at, at + window)),
                    signed(Spans(words.hashes(1), 1)(at, at + window)),
                    pa.array((at - words.first[owner]).astype(np.int32)),
                ],
                ["doc_id", "row", "edge", "edge2", "lo"],
            )


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text")


def _written(df: DataFrame, label: str) -> DataFrame:
    """A table written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sources(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that several documents hold, with the smallest of these as ``source``."""
    return rows.groupBy(*key).agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).filter("source < last").drop("last")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Covered windows as (doc_id, row, lo, n, source): words lo to lo + n + window - 1 recur in ``source``.

    ``source`` is the smallest document that holds the path or window, and is smaller than doc_id; ``row`` is the
    hash of the text.
    """
    texts = _rows(docs).filter("doc_id IS NOT NULL")
    kind = texts.schema["doc_id"].dataType.simpleString()
    paths = _written(texts.mapInArrow(lambda it: _paths(it, window, anchor), f"doc_id {kind}, row long, anchor long, path long, lo int, n int"), "paths")
    # an anchor that one document holds neither recurs nor branches
    several = _sources(paths, ["anchor"]).select("anchor")
    shared, _ = keyset.divided(paths, _written(several, "anchors"), ["anchor"])
    key = ["anchor", "path"]
    # written, so that both sides of the join come straight from exchanges and Spark can split a hot path's rows
    compact = _written(_sources(shared, key), "compact")
    # the hashes are only needed further on where the document is the source itself
    hashes = [F.when(F.expr("source = doc_id"), F.col(k)).alias(k) for k in key]
    sourced = shared.join(compact, key, "left").withColumn("source", F.coalesce("source", "doc_id"))
    found = _written(sourced.select("doc_id", "row", "lo", "n", "source", *hashes), "found")
    whole = found.filter("source < doc_id").select("doc_id", "row", "lo", "n", "source")
    # an anchor with different paths in different documents: the graph branches there
    own = found.filter("source = doc_id")
    branching = _sources(own, ["anchor"])
    # a passage that many texts share makes hot anchors: their paths are dealt out by salt
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = own.withColumn("salt", F.pmod(F.col("path"), F.lit(SALTS)).cast("int"))
    apart = salted.join(branching.select("anchor", salts), ["anchor", "salt"], "left_semi").select("doc_id", "row", "lo", "n")
    listed = _written(apart.groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "n")).alias("paths")), "listed")
    branched, _ = keyset.divided(texts, listed, ["doc_id", "row"])
    edges = _written(
        branched.join(listed, ["doc_id", "row"]).mapInArrow(lambda it: _edges(it, window), f"doc_id {kind}, row long, edge long, edge2 long, lo int"), "edges"
    )
    least = _written(_sources(edges, ["edge", "edge2"]), "least")
    recurring, _ = keyset.divided(edges, least, ["edge", "edge2"])
    single = recurring.join(least, ["edge", "edge2"]).filter("source < doc_id").select("doc_id", "row", "lo", F.lit(1).alias("n"), "source")
    return whole.unionByName(single)


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words = split_words(part.column("text"))
            counts = words.counts
            marks = np.zeros(len(words.start) + 1, np.int64)
            listed = part.column("spans")
            sizes = np.diff(listed.offsets.to_numpy())
            flat = listed.flatten()
            if len(flat):
                doc = np.repeat(np.arange(len(words)), sizes)
                lo = flat.field("lo").to_numpy(zero_copy_only=False) + words.first[doc]
                n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(marks, lo, 1)
                np.add.at(marks, lo + n - 1 + window, -1)
            keep = np.cumsum(marks)[:-1] == 0
            texts, removed = [], []
            raw = words.data.tobytes()
            for i in range(len(words)):
                a, b = words.first[i], words.first[i + 1]
                k = keep[a:b]
                removed.append(int(len(k) - k.sum()))
                if removed[-1] == 0:
                    texts.append(b" ".join(raw[words.offsets[i] : words.offsets[i + 1]].split()))
                else:
                    texts.append(b" ".join(raw[s:e] for s, e in zip(words.start[a:b][k].tolist(), words.end[a:b][k].tolist())))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(counts.astype(np.int64)),
                    pa.array(np.array(removed, np.int64)),
                    pa.array(texts, pa.binary()),
                ],
                ["doc_id", "n_words", "n_removed", "kept"],
            )


def remove_spans(docs: DataFrame, spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words left in each document, joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # at most one entry per window of the document itself, however often rows repeat id and text
    listed = _written(spans.groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "n")).alias("spans")), "spans")
    empty = F.expr("cast(array() AS array<struct<lo: int, n: int>>)")
    # only texts that may have spans go to the join
    some, none = keyset.divided(_rows(docs), listed, ["doc_id", "row"])
    joined = some.join(listed, ["doc_id", "row"], "left").withColumn("spans", F.coalesce("spans", empty))
    return joined.unionByName(none.withColumn("spans", empty)).mapInArrow(lambda it: _kept(it, window), f"doc_id {kind}, n_words long, n_removed long, kept binary")


def maximal_spans(spans: DataFrame, window: int = WINDOW) -> DataFrame:
    """Covered words as maximal spans (doc_id, start, end, source) of each row, with the smallest source among
    their parts."""
    kind = spans.schema["source"].dataType.simpleString()
    listed = spans.groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("lo", (F.col("lo") + F.col("n") - 1 + window).alias("hi"), "source"))).alias("s")
    )
    merged = F.expr(
        f"aggregate(s, cast(array() AS array<struct<lo: int, hi: int, source: {kind}>>), (a, x) -> "
        "CASE WHEN size(a) > 0 AND element_at(a, -1).hi >= x.lo THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).lo AS lo, "
        "greatest(element_at(a, -1).hi, x.hi) AS hi, least(element_at(a, -1).source, x.source) AS source))) "
        "ELSE concat(a, array(struct(x.lo AS lo, x.hi AS hi, x.source AS source))) END)"
    )
    return listed.select("doc_id", F.explode(merged).alias("m")).select("doc_id", F.col("m.lo").alias("start"), F.col("m.hi").alias("end"), "m.source")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of what every document keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_spans(docs, repeated_spans(docs))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}

_SPACE = r"[\x20\x09-\x0D]+"
ORACLES = {
    "op2_substring_dedup": rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
n AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 48, 1))) AS i FROM w),
win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM n),
least AS (SELECT h, min(doc_id) AS source FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN least USING (h), (SELECT unnest(range(50)) AS k) WHERE source < doc_id),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
}
