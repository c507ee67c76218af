"""Alignment of two tokenizations of the same texts, token by token and over the whole corpus.

Side A is a byte-level BPE vocabulary (``bpe_automaton``), side B a SentencePiece model. Both encode a space
and the text. Per batch of about 4 MB of text, ``pandas.merge_asof``, keyed by document, finds for every token's
first byte the covering token of the other side; the union of both directions is every overlapping pair. Bytes where
tokens of both sides end cut a document into groups.

How often an id pair is linked in the corpus is counted from the batches' own counts, so a frequent pair
travels once per batch, not once per link. The totals return to the batches as one number per distinct pair;
links stand in the written table as places in that list. The highest count per B id is one row per
entry of the vocabulary.

Side B never joins characters over the beginning of a run of spaces (checked against its vocabulary), so
texts are cut there, and equal parts of a batch are encoded once.

Defined results: texts that are null or empty, or that B does not give back byte for byte (those with
U+2581, which B takes for a space), have no tokens: zeros, and an empty digest; repeated rows and rows with a
null id count each; texts of any length, a batch holds one text at least; extra columns are ignored; an
empty table gives no row. Equal counts are equally best.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.llm.bpe import VOCABULARY, compiled, encode_texts, text_buffers
from opslens.llm.bpe_automaton import spread
from opslens.llm.packing import tokenizer_path
from opslens.llm.textnum import Spans, buffers, chunks
from opslens.session import scratch_path

PIECES = "piece_bpe_32k.model"
PART = 1_000_000  # bytes of text at once
BATCH = 4_000_000  # bytes of text whose links share a list of pairs
SPACE = "▁"


class PieceEncoder:
    """Ids and bytes of a SentencePiece model that was read into memory."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.labels = [bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.sizes = np.array([len(x) for x in self.labels], np.int64)
        self.heads = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(self.labels), np.uint8)
        plain = [x for i, x in enumerate(names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        # no piece goes on with a space after another character
        self.parts = not any(SPACE in x.lstrip(SPACE) for x in plain)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that each begin with the space the model adds, and where each text's begin. A text with
        U+2581 may be cut otherwise than whole; it has no alignment either way."""
        first = np.unique(offsets[:-1][np.diff(offsets) > 0])
        start = first
        if self.parts:
            space = data == 0x20
            new = space.copy()
            new[1:] &= ~space[:-1]
            new[first] = True
            start = np.flatnonzero(new)
        end = np.append(start[1:], len(data)) if len(start) else start
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        _, some, which = np.unique(Spans(data)(start, end), return_index=True, return_inverse=True)
        raw = data.tobytes()
        coded = self.model.encode([raw[a + 1 : b].decode() for a, b in zip(start[some].tolist(), end[some].tolist())], num_threads=1)
        # a part that is the added space alone: the model has nothing to encode, the space is a token of its own
        lone = self.model.piece_to_id(SPACE)
        coded = [c or [lone] for c in coded]
        size = np.array([len(c) for c in coded], np.int64)
        pool = np.fromiter((i for c in coded for i in c), np.int64, int(size.sum()))
        n = size[which]
        ids = pool[spread((np.cumsum(size) - size)[which], n)]
        return ids, np.append(0, np.cumsum(n))[np.searchsorted(start, offsets)]

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[ids]
        return self.pool[spread(self.heads[ids], n)], n


def links(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """(a, b): places of all overlapping tokens. The frames have ``doc, at``, the first byte counted over
    all documents, in that order; each document's tokens cover the same bytes on both sides."""
    a, b = a.assign(a=np.arange(len(a))), b.assign(b=np.arange(len(b)))
    covering_b = pd.merge_asof(a, b.rename(columns={"at": "at_b"}).assign(at=b["at"]), on="at", by="doc")
    covering_a = pd.merge_asof(b, a.rename(columns={"at": "at_a"}).assign(at=a["at"]), on="at", by="doc")
    # tokens that begin together are found from both sides
    covering_a = covering_a[covering_a["at"] != covering_a["at_a"]]
    return pd.concat([covering_b[["a", "b"]], covering_a[["a", "b"]]], ignore_index=True).astype(np.int64)


@functools.lru_cache(maxsize=2)
def _numerals(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal digits and one more byte for each number, back to back, with places and sizes."""
    texts = [b"%d," % i for i in range(size)]
    n = np.array([len(x) for x in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(n) - n, n


def group_texts(ids_a, ids_b, group_a, group_b, doc_a, doc_b, docs: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` per document, from ids, groups and documents of both sides' tokens in order."""
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    end = np.empty(len(ids), np.uint8)
    # a group's A tokens, then its B tokens
    place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")
    place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
    for ids_of, group, place, sign in ((ids_a, group_a, place_a, "|"), (ids_b, group_b, place_b, ";")):
        ids[place] = ids_of
        last = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
        end[place] = np.where(last, ord(sign), ord(","))
    pool, heads, sizes = _numerals(int(ids.max(initial=0)) + 1 if len(ids) < 1000 else 1 << 17)
    n = sizes[ids]
    text = pool[spread(heads[ids], n)]
    ends = np.cumsum(n)
    text[ends - 1] = end
    count = np.bincount(doc_a, minlength=docs) + np.bincount(doc_b, minlength=docs)
    cut = np.append(0, ends)[np.append(0, np.cumsum(count))].tolist()
    raw = text.tobytes()
    return [raw[x : y - 1] if y > x else b"" for x, y in zip(cut, cut[1:])]


def _align(batches: Iterator[pa.RecordBatch], shared, with_groups: bool) -> Iterator[pa.RecordBatch]:
    (automaton, split), model = shared.value
    pieces = PieceEncoder(model)
    if with_groups:
        for batch in batches:
            for part in chunks(batch, limit=PART):
                _, _, groups = _align_part(part, automaton, split, pieces)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g.decode() for g in groups])], ["doc_id", "groups"])
        return
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    pairs: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for part in chunks(batch, limit=PART):
            rows, pair, groups = _align_part(part, automaton, split, pieces)
            digest = pa.array([sha256(g).hexdigest() if g else "" for g in groups])
            held.append(pa.RecordBatch.from_arrays([*rows.columns, digest], [*rows.schema.names, "digest"]))
            pairs.append(pair)
            size += buffers(part.column("text"))[1][-1]
            if size >= BATCH:
                yield _listed(held, pairs, number)
                held, pairs, size, number = [], [], 0, number + 1
    if held:
        yield _listed(held, pairs, number)


def _listed(held: list[pa.RecordBatch], pairs: list[np.ndarray], number: int) -> pa.RecordBatch:
    """One batch: links as places in the list of its distinct pairs, which travels in the first row."""
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    pair, place, count = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
    cut = np.append(0, np.cumsum(rows.column("n_links").to_numpy())).tolist()
    raw = place.astype("<u4").tobytes()
    blank = [None] * (len(rows) - 1)
    extra = [
        pa.array(np.full(len(rows), number)),
        pa.array([raw[4 * x : 4 * y] for x, y in zip(cut, cut[1:])], pa.binary()),
        pa.array([pair] + blank, pa.list_(pa.int64())),
        pa.array([count] + blank, pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays([*rows.columns, *extra], [*rows.schema.names, "batch", "links", "pairs", "counts"])


def _align_part(part: pa.RecordBatch, automaton, split, pieces: PieceEncoder) -> tuple[pa.RecordBatch, np.ndarray, list[bytes]]:
    """Counts per document, the id pair of each link (documents in order), and the groups' texts."""
    texts = part.column("text").cast(pa.large_string()).fill_null("")
    spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string()))
    data, offsets = text_buffers(pc.if_else(pc.equal(texts, ""), texts, spaced))
    size = np.diff(offsets)
    ids_a, first_a = encode_texts(automaton, split, data, offsets, special=False)
    ids_a = ids_a.astype(np.int64)
    ids_b, first_b = pieces(data, offsets)
    doc_a, doc_b = np.repeat(np.arange(len(part)), np.diff(first_a)), np.repeat(np.arange(len(part)), np.diff(first_b))
    good = size > 0
    for doc, ids, side in ((doc_a, ids_a, automaton), (doc_b, ids_b, pieces)):
        good &= np.bincount(doc, side.sizes[ids], len(part)).astype(np.int64) == size
        joined, _ = side.bytes_of(ids[good[doc]])
        wrong = np.repeat(np.arange(len(part)), size * good)[joined != data[np.repeat(good, size)]]
        good[wrong] = False
    if not good.all():
        keep_a, keep_b = good[doc_a], good[doc_b]
        ids_a, doc_a, ids_b, doc_b = ids_a[keep_a], doc_a[keep_a], ids_b[keep_b], doc_b[keep_b]
    # bytes are counted over the texts that take part
    end_a, end_b = np.cumsum(automaton.sizes[ids_a]), np.cumsum(pieces.sizes[ids_b])
    a = pd.DataFrame({"doc": doc_a, "at": end_a - automaton.sizes[ids_a]})
    b = pd.DataFrame({"doc": doc_b, "at": end_b - pieces.sizes[ids_b]})
    both = links(a, b)
    link_a, link_b = both["a"].to_numpy(), both["b"].to_numpy()
    link_doc = doc_a[link_a]
    order = np.argsort(link_doc, kind="stable")
    pair = ids_a[link_a[order]] << 32 | ids_b[link_b[order]]
    ends = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
    groups = group_texts(ids_a, ids_b, group_a, group_b, doc_a, doc_b, len(part))
    per_doc = lambda x: pa.array(np.bincount(x, minlength=len(part)))
    counts = [per_doc(x) for x in (doc_a, doc_b, doc_a[np.searchsorted(end_a, ends)], link_doc)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), *counts], ["doc_id", "n_a", "n_b", "n_groups", "n_links"]), pair, groups


def _sums(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """Per document of a batch, the sum of its links' counts and how many are best for their B id."""
    marks = marks.sort_by("place")
    total, best = marks.column("total").to_numpy(), marks.column("best").to_numpy()
    n = docs.column("n_links").to_numpy()
    place = np.frombuffer(b"".join(docs.column("links").to_pylist()), "<u4")
    ends = np.cumsum(n)
    sums = lambda x: (lambda c: c[ends] - c[ends - n])(np.append(0, np.cumsum(x[place].astype(np.int64)))) if len(x) else np.zeros(len(n), np.int64)
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(sums(best))).append_column("count_sum", pa.array(sums(total))).append_column("groups_sha256", docs.column("digest"))


class Alignment:
    """Aligned documents: a written table, with views of its contents."""

    def __init__(self, docs: DataFrame, vocabulary: str | None = None, model: str | None = None):
        spark = docs.sparkSession
        with open(model or tokenizer_path(PIECES), "rb") as f:
            shared = spark.sparkContext.broadcast((compiled(vocabulary or tokenizer_path(VOCABULARY)), f.read()))
        kind = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, digest string, batch long, links binary, pairs array<long>, counts array<long>"
        texts = docs.select("doc_id", "text")
        # the groups of a document are as long as its text: their digest is kept, the groups come on demand
        self._groups = texts.mapInArrow(lambda it: _align(it, shared, True), f"doc_id {kind}, groups string")
        self.spark, self.kind = spark, kind
        self.path = scratch_path(spark, "aligned")
        texts.mapInArrow(lambda it: _align(it, shared, False), schema).write.option("compression", "zstd").parquet(self.path)
        listed = spark.read.parquet(self.path).filter("pairs IS NOT NULL").select("batch", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p"))
        self._listed = listed.select("batch", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
        self._pairs_path = scratch_path(spark, "aligned-pairs")
        self._listed.groupBy("pair").agg(F.sum("n").alias("total")).write.parquet(self._pairs_path)

    def groups(self) -> DataFrame:
        """(doc_id, groups): ids of each group as text, computed anew."""
        return self._groups

    def pairs(self) -> DataFrame:
        """(a, b, total, best): how often ids are linked in the corpus, and whether that is B's highest."""
        read = lambda: self.spark.read.parquet(self._pairs_path).select(
            F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "pair", "total"
        )
        # at most one row per entry of B's vocabulary
        highest = F.broadcast(read().groupBy("b").agg(F.max("total").alias("highest")))
        return read().join(highest, "b").select("a", "b", "pair", "total", (F.col("total") == F.col("highest")).alias("best"))

    def documents(self) -> DataFrame:
        """Counts and digests per document."""
        marks = self._listed.join(self.pairs().select("pair", "total", F.col("best").cast("int").alias("best")), "pair").select("batch", "place", "total", "best")
        docs = self.spark.read.parquet(self.path).select("batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "digest", "links")
        schema = f"doc_id {self.kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        return docs.groupBy("batch").cogroup(marks.groupBy("batch")).applyInArrow(_sums, schema)


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> Alignment:
    """Aligns ``doc_id, text`` rows; ``vocabulary`` and ``model`` are files the driver reads."""
    return Alignment(docs, vocabulary, model)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, link sums and group digests of every document."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents()


QUERIES = {"op11_token_alignment": op11_token_alignment}
