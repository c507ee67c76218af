"""BPE encoding and decoding by a tokenization automaton (``bpe_automaton``).

Texts are cut into pieces, the distinct pieces of about 1 MB of text are read through the automaton's
tables side by side, and decoding emits the arc labels of the ids. The automaton is compiled once, on
the driver, from the vocabulary file and sent to the tasks as a few arrays; tasks need no file.

Defined results: a null or empty text has no ids and decodes to the empty text; texts may be of any
length, a piece of more than 48 bytes is read on its own; bytes that are no UTF-8 count as U+FFFD; repeated
rows and rows with a null id are encoded each; extra columns are ignored; an empty table gives no
row. Decoding takes ids without a label as nothing, and bytes that form no character as U+FFFD.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.llm import bpe_automaton
from opslens.llm.bpe_automaton import Automaton, Splitter, spread
from opslens.llm.packing import tokenizer_path
from opslens.llm.textnum import buffers, chunks

VOCABULARY = "byte_bpe_50k.json"
CHUNK = 1 << 20


@functools.lru_cache(maxsize=4)
def compiled(path: str) -> tuple[Automaton, Splitter]:
    return bpe_automaton.load(path)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column, as valid UTF-8; null counts as empty."""
    data, offsets = buffers(column)
    raw = data.tobytes()
    try:
        raw.decode()
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])]
        return buffers(pa.array(texts, pa.large_string()))
    return data, offsets


def encode_texts(automaton: Automaton, split: Splitter, data: np.ndarray, offsets: np.ndarray, special: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts back to back, and where each text's ids begin. With ``special``, the strings of
    special tokens are cut out first and become their ids."""
    marks = np.zeros(0, np.int64)
    bounds = offsets
    if special and automaton.special:
        names = sorted(automaton.special, key=len, reverse=True)
        found = [(m.start(), m.end(), automaton.special[m.group()]) for m in re.finditer(b"|".join(map(re.escape, names)), data.tobytes())]
        # texts stand back to back; what two texts make together is no match
        found = [f for f in found if np.searchsorted(offsets, f[0], "right") == np.searchsorted(offsets, f[1], "left")]
        if found:
            marks = np.array([f[0] for f in found], np.int64)
            bounds = np.sort(np.concatenate([offsets, marks, [f[1] for f in found]]))
    start, _ = split(data, bounds)
    end = np.append(start[1:], len(data)) if len(start) else start
    if len(marks):
        inside = np.zeros(len(start), bool)
        for a, b, _ in found:
            inside[np.searchsorted(start, a) : np.searchsorted(start, b)] = True
        start, end = start[~inside], end[~inside]
    ids, n = automaton.pieces(data, start, end)
    if len(marks):
        at = np.concatenate([start, marks])
        order = np.argsort(at, kind="stable")
        heads = np.append(np.cumsum(n) - n, len(ids) + np.arange(len(marks)))
        pool = np.append(ids, np.array([f[2] for f in found], np.int32))
        start, n = at[order], np.append(n, np.ones(len(marks), np.int64))[order]
        ids = pool[spread(heads[order], n)]
    return ids, np.append(0, np.cumsum(n))[np.searchsorted(start, offsets)]


def _encode(batches: Iterator[pa.RecordBatch], shared, special: bool) -> Iterator[pa.RecordBatch]:
    automaton, split = shared.value
    for batch in batches:
        for part in chunks(batch, limit=CHUNK):
            ids, first = encode_texts(automaton, split, *text_buffers(part.column("text")), special)
            raw = ids.astype("<u4").tobytes()
            packed = pa.array([raw[4 * a : 4 * b] for a, b in zip(first.tolist(), first[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), packed], ["doc_id", "n_tokens", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    automaton, _ = shared.value
    for batch in batches:
        at = 0
        while at < len(batch):
            # about as many ids at once as a chunk of text has
            end, size = at, 0
            while end < len(batch) and (end == at or size < 4 * CHUNK):
                size += len(batch.column("ids")[end].as_py() or b"")
                end += 1
            part = batch.slice(at, end - at)
            blobs = [b or b"" for b in part.column("ids").to_pylist()]
            ids = np.frombuffer(b"".join(blobs), "<u4").astype(np.int64)
            ends = np.append(0, np.cumsum([len(b) // 4 for b in blobs]))
            known = ids < len(automaton.sizes)
            data, n = automaton.bytes_of(np.where(known, ids, 0))
            if not known.all():
                data, n = data[np.repeat(known, n)], n * known
            cut = np.append(0, np.cumsum(n))[ends].tolist()
            raw = data.tobytes()
            texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "n_tokens", "ids")] + [texts], ["doc_id", "n_tokens", "ids", "text"])
            at = end


def encode(docs: DataFrame, vocabulary: str | None = None, special: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit values. With ``special``, strings of
    special tokens in a text become those tokens, otherwise they are plain text."""
    shared = docs.sparkSession.sparkContext.broadcast(compiled(vocabulary or tokenizer_path(VOCABULARY)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _encode(it, shared, special), f"doc_id {kind}, n_tokens long, ids binary")


def decode(coded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of rows with ids as ``encode`` returns them."""
    shared = coded.sparkSession.sparkContext.broadcast(compiled(vocabulary or tokenizer_path(VOCABULARY)))
    kind = coded.schema["doc_id"].dataType.simpleString()
    rows = coded.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(lambda it: _decode(it, shared), f"doc_id {kind}, n_tokens long, ids binary, text string")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text they decode to."""
    coded = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op13_bpe": op13_bpe}
