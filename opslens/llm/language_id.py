"""Language identification with a blended spectrum kernel.

A text is the set of its byte bigrams and trigrams (ASCII letters in lower case), hashed into
``BINS`` bins each; the kernel of two texts is the blend of their common n-grams, normalised. Over
``LANDMARKS`` texts of a bounded sample (Nyström) a kernel ridge regression is fitted for each
language against the rest. Scoring is two matrix products per batch: presence times landmarks, then
kernel times weights. Only landmarks and weights travel to the tasks.

Defined results: a null text and a text without a letter are ``und`` with score 0; if nothing can be
learned from, every text is ``und``; ties go to the language that sorts first; repeated rows give one
row each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opslens.llm.sampling import id_remainder, labelled_sample
from opslens.llm.textnum import LOWER, buffers, chunks

SAMPLE = 6_000  # labelled documents to learn from
LANDMARKS = 192
BINS = (4096, 8192)  # of bigrams and trigrams
RIDGE = 1e-3
SHARPNESS = 6.0
ROWS = 128  # texts in one matrix product
UNKNOWN = "und"


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0/1 matrix of texts by n-gram bins."""
    out = np.zeros((len(offsets) - 1, sum(BINS)), np.float32)
    low = LOWER[data].astype(np.uint32)
    two = low[:-1] | (low[1:] << np.uint32(8))
    three = two[:-1] | (low[2:] << np.uint32(16))
    bins = []
    for grams, size in ((two, BINS[0]), (three, BINS[1])):
        bins.append((grams * np.uint32(2654435761)) >> np.uint32(32 - (size.bit_length() - 1)))
    bins[1] += np.uint32(BINS[0])
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        out[i, bins[0][a : max(b - 1, a)]] = 1
        out[i, bins[1][a : max(b - 2, a)]] = 1
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[*range(65, 91), *range(97, 123)]] = True
    seen = np.concatenate([[0], np.cumsum(ascii_letter[data])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(x.sum(1), 1))


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised number of common n-grams."""
    return (x @ landmarks.T) * _unit(x)[:, None] * _unit(landmarks)[None, :]


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # 0/1 bytes
    weights: np.ndarray  # landmarks and a constant, by language

    def predict(self, x: np.ndarray, landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each row; ``landmarks`` as floats."""
        k = kernel(x, landmarks)
        f = np.column_stack([k, np.ones(len(k))]) @ self.weights
        best = f.argmax(1)
        e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
        return best, (e / e.sum(1, keepdims=True))[np.arange(len(f)), best]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in chunks(batch):
            for at in range(0, len(part), ROWS):
                rows = part.slice(at, ROWS)
                yield rows, *buffers(rows.column("text"))


def _landmark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in _pieces(batches):
        x = presence(data, offsets).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([np.packbits(r).tobytes() for r in x], pa.binary())], ["doc_id", "bits"])


def train(docs: DataFrame, allowed: Column, limit: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """One-versus-rest ridge regressions over landmark kernels of the sample."""
    sample = labelled_sample(docs, docs.select("doc_id", "lang"), "lang", allowed, limit)
    sample = sample.filter("text IS NOT NULL")
    chosen = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(landmarks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = chosen.select("doc_id", "text").mapInArrow(_landmark_rows, f"doc_id {kind}, bits binary").toPandas()
    if not len(rows):
        return Model([], np.zeros((0, sum(BINS)), np.uint8), np.zeros((1, 0)))
    marks = np.stack([np.unpackbits(np.frombuffer(b, np.uint8))[: sum(BINS)] for b in rows.sort_values("doc_id")["bits"]])

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floats = marks.astype(np.float32)
        for rows, data, offsets in _pieces(batches):
            k = kernel(presence(data, offsets), floats)
            yield pa.RecordBatch.from_arrays([rows.column("label"), pa.array([r.astype("<f4").tobytes() for r in k], pa.binary())], ["label", "k"])

    table = sample.select("label", "text").mapInArrow(kernels, "label string, k binary").toPandas()
    k = np.stack([np.frombuffer(b, "<f4") for b in table["k"]]).astype(float)
    languages = sorted(table["label"].unique())
    y = np.where(table["label"].to_numpy()[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # balanced: every language weighs the same against the rest
    floats = marks.astype(np.float32)
    inner = np.zeros((len(marks) + 1, len(marks) + 1))
    inner[:-1, :-1] = kernel(floats, floats)
    features = np.column_stack([k, np.ones(len(k))])
    weights = np.zeros((len(marks) + 1, len(languages)))
    for j in range(len(languages)):
        own = y[:, j] > 0
        w = np.where(own, 0.5 / max(own.sum(), 1), 0.5 / max((~own).sum(), 1)) * len(own)
        left = (features * w[:, None]).T @ features + RIDGE * len(k) * inner + 1e-6 * len(k) * np.eye(len(inner))
        weights[:, j] = np.linalg.solve(left, features.T @ (w * y[:, j]))
    return Model(languages, marks, weights)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floats = model.landmarks.astype(np.float32)
        names = np.array(model.languages + [UNKNOWN], object)
        for rows, data, offsets in _pieces(batches):
            known = has_letter(data, offsets) if model.languages else np.zeros(len(rows), bool)
            best, score = np.full(len(rows), len(model.languages)), np.zeros(len(rows))
            if model.languages:
                best, score = model.predict(presence(data, offsets), floats)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(names[np.where(known, best, len(model.languages))], pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents whose id hash leaves 1 modulo 3 are never learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = id_remainder(3)
    out = identify(docs, train(docs, rest != 1))
    return out.select("doc_id", (rest == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
