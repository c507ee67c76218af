"""Concatenate and cut: documents become one token stream that is cut into sequences of fixed length.

Pass one writes each document's ids with the tokens before it in its partition. The partition totals,
one number per partition, are summed up to give every partition its place in the stream. Pass two
cuts each document at the multiples of the sequence length: a piece is a boundary record if the
document goes on before or after it. Only the last sequence can need padding.

Ids stand in two bytes where the vocabulary allows it. The word-level vocabulary splits at white
space, so a word is encoded once per task and looked up again afterwards (at most ``CACHE`` words).

Defined results: null and empty texts are the end id alone; repeated rows are packed each; extra columns
are ignored; an empty table gives no piece. The order of the stream is that of the input's partitions.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from opslens.llm.textnum import chunks, split_words
from opslens.session import scratch_path

LENGTH = 4096
END = 2
CACHE = 400_000
TOKENIZER = "word_bpe_49k.json"
PLACES = 1_000_000  # partition totals up to this number, 16 bytes each, are broadcast


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# words of printable ASCII and of Latin letters that have one lower case form and no other composition
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]+")
# fixed values: how this vocabulary's pre-tokenizer cuts such a word, once in lower case
CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u017f]+|[0-9]|[!-/:-@\\[-`{-~]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte beyond printable ASCII in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids of texts by a tokenizer that never joins words over white space.

    Plain words of the known pre-tokenizer are cut here and only their parts go through the model, which
    gives the same ids at a fraction of the cost; all others take the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # ids as bytes: short, and nothing for the garbage collector to walk through
        self.code = [i.to_bytes(self.kind.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.cuts_here = os.path.basename(path) == TOKENIZER
        letters = byte_letters()
        self.letters = {i: "".join(letters[b] for b in chr(i).encode()) for i in range(0xC0, 0x180)}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            shown = part if part.isascii() else part.translate(self.letters)
            ids = self.parts[part] = b"".join([self.code[t.id] for t in self.tokenize(shown)])
        return ids

    def _plain(self, word: str) -> bytes:
        lower = word.lower()
        # letters alone are one part
        return self._part(lower) if word.isalpha() else b"".join(map(self._part, CUT.findall(lower)))

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        if len(self.parts) > CACHE:
            self.parts.clear()
        out = list(map(self.known.get, words))
        odd = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            raw = words[i]
            word = raw.decode()
            if self.cuts_here and (raw.isascii() and word.isprintable() or PLAIN.fullmatch(word)):
                out[i] = self.known[raw] = self._plain(word)
            else:
                odd.append(i)
        for i, coded in zip(odd, self.tokenizer.encode_batch([words[i].decode() for i in odd], add_special_tokens=False)):
            out[i] = self.known[words[i]] = b"".join([self.code[t] for t in coded.ids])
        return out

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text followed by ``END``, and where each text begins."""
        words = split_words(column)
        coded_as = pa.array(words.hashes()).dictionary_encode()
        which = coded_as.indices.to_numpy().astype(np.int64)
        at = np.empty(len(coded_as.dictionary), np.int64)
        at[which[::-1]] = np.arange(len(which) - 1, -1, -1)  # first place of each distinct word
        raw = words.data.tobytes()
        coded = self._of_words([raw[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist())])
        coded.append(self.code[END])
        # each text is its words and one end mark
        order = np.insert(which, words.first[1:], len(at))
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // self.kind.itemsize
        heads = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(coded), self.kind)
        n = sizes[order]
        ends = np.cumsum(n)
        ids = pool[np.repeat(heads[order] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)]
        return ids, np.append(0, ends[words.first[1:] + np.arange(len(words))])


def _tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = WordEncoder(path)
    place, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in chunks(batch):
            ids, first = encode(part.column("text"))
            raw = ids.tobytes()
            width = encode.kind.itemsize
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.full(len(part), place, np.int32)),
                    pa.array(first[:-1] + before),
                    pa.array(np.diff(first)),
                    pa.array([raw[a * width : b * width] for a, b in zip(first[:-1].tolist(), first[1:].tolist())], pa.binary()),
                ],
                ["doc_id", "place", "before", "n", "ids"],
            )
            before += int(first[-1])


def _pieces(batches: Iterator[pa.RecordBatch], length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("n").to_numpy()
        at = batch.column("at").to_numpy()
        count = (at + n - 1) // length - at // length + 1
        row = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        sequence = at[row] // length + k
        begin = np.maximum(sequence * length, at[row])
        end = np.minimum((sequence + 1) * length, at[row] + n[row])
        start = begin - at[row]
        raw = batch.column("ids")
        crc, out = [], []
        last, ids = -1, b""
        for r, s, size in zip(row.tolist(), start.tolist(), (end - begin).tolist()):
            if r != last:
                blob = raw[r].as_py()
                ids, last = np.frombuffer(blob, f"<u{len(blob) // int(n[r])}").astype("<u4").tobytes(), r
            piece = ids[4 * s : 4 * (s + size)]
            crc.append(zlib.crc32(piece))
            out.append(piece if with_ids else None)
        columns = [
            batch.column("doc_id").take(pa.array(row)),
            pa.array(start),
            pa.array(end - begin),
            pa.array(crc, pa.int64()),
            pa.array(n[row]),
            pa.array(sequence),
            pa.array(begin - sequence * length),
            pa.array((start > 0) | (end - at[row] < n[row])),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"]
        yield pa.RecordBatch.from_arrays(columns + ([pa.array(out, pa.binary())] if with_ids else []), names + ["ids"] * with_ids)


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids as little-endian unsigned 32-bit values."""
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    where = scratch_path(spark, "tokens")
    rows = docs.select("doc_id", "text").mapInArrow(lambda it: _tokens(it, path), f"doc_id {kind}, place int, before long, n long, ids binary")
    rows.write.option("compression", "zstd").parquet(where)
    rows = spark.read.parquet(where)
    # one row per partition, whatever the number of documents
    totals = rows.groupBy("place").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    sums = totals.select("place", (F.sum("total").over(Window.orderBy("place")) - F.col("total")).alias("base"))
    sums_path = scratch_path(spark, "places")
    sums.write.parquet(sums_path)
    sums = spark.read.parquet(sums_path)
    if sums.count() <= PLACES:
        sums = F.broadcast(sums)
    placed = rows.join(sums, "place").select("doc_id", "n", "ids", (F.col("base") + F.col("before")).alias("at"))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"
    return placed.mapInArrow(lambda it: _pieces(it, length, with_ids), schema + ", ids binary" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): whole sequences of pieces with ids; a group is at most one sequence long."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.expr("aggregate(parts, cast('' AS binary), (a, p) -> concat(a, p.ids))")
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", joined.alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_packing": op3_packing}
