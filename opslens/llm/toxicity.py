"""Toxic passages by maximal scoring segments of token log-odds.

Tokens are words in lower case and their beginnings. Over a bounded sample of labelled documents the
log-odds of each token between toxic and other documents are estimated under an informative
Dirichlet prior (the tokens' overall shares); tokens with a significant excess score their log-odds,
every other word costs a fixed amount. One linear scan per document finds all maximal scoring
segments. The greatest segment score of clean documents follows an extreme-value law in the document's
length; its parameters turn scores of documents of any length into one scale, and a logistic curve
on that scale gives the probability. Only the model (at most ``VOCABULARY`` tokens) is broadcast.

Defined results: null, empty and wordless texts score like a clean text without toxic words; without
labels of both kinds to learn from the model is empty and every score is near 1 if only toxic labels are
known, else near 0;
repeated rows give one row each; extra columns are ignored or kept as they are by ``reject``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.llm.sampling import id_remainder, labelled_sample
from opslens.llm.textnum import Spans, Words, chunks, mix, signed, split_words

SAMPLE = 20_000  # labelled documents to learn from
VOCABULARY = 20_000  # tokens in the model
BEGINNINGS = (5, 6, 7, 8, 10)  # bytes
PRIOR = 500.0  # weight of the prior in documents
SIGNIFICANT = 4.0  # standard deviations
DRIFT = 0.3  # cost of a word that is no token of the model
SIGNIFICANT_SEGMENT = 2.0
SILENT_WORDS = 100


def tokens(words: Words) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings; a word that is not longer than one repeats."""
    spans = Spans(words.data)
    out = [spans(words.start, words.end)]
    for n in BEGINNINGS:
        out.append(mix(spans(words.start, np.minimum(words.start + n, words.end)) ^ np.uint64(n)))
    return out


@dataclass
class Model:
    """Token scores and the calibration."""

    token: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rate: float = 1.0  # lambda of the extreme-value law
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -20.0

    def word_scores(self, words: Words) -> np.ndarray:
        """Best log-odds among a word's tokens; 0 if none is in the model."""
        best = np.zeros(len(words.start))
        if len(self.token):
            for hashes in tokens(words):
                at = np.minimum(np.searchsorted(self.token, hashes), len(self.token) - 1)
                np.maximum(best, np.where(self.token[at] == hashes, self.odds[at], 0.0), out=best)
        return best

    def segments(self, words: Words) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """(text, maximal segments) of every text with a scoring word; word offsets are within the text."""
        scores = self.word_scores(words)
        hits = np.flatnonzero(scores > 0)
        at = np.searchsorted(hits, words.first)
        for text in np.flatnonzero(np.diff(at)).tolist():
            own = hits[at[text] : at[text + 1]]
            yield text, maximal_segments((own - words.first[text]).tolist(), (scores[own] - DRIFT).tolist())

    def scale(self, score: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Greatest segment scores on the scale of the extreme-value law: minus the log of the expected number.

        A text without a scoring word counts as ``SILENT_WORDS`` words at least: being short is no sign.
        """
        length = np.maximum(n_words, np.where(score > 0, 1, SILENT_WORDS))
        return self.rate * score - np.log(length) - self.log_k

    def probability(self, score: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * self.scale(score, n_words), -40, 40)))


def maximal_segments(place: list[int], gain: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text whose other words each cost ``DRIFT``.

    One pass with a stack of candidate segments, each with the running totals at its two ends and the place of the
    nearest earlier one that starts lower. Looking back follows those places only; what it passes over is
    never looked at again, so the time is linear.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, earlier one that starts lower
    total, last = 0.0, -1
    for at, value in zip(place, gain):
        total -= DRIFT * (at - last - 1)
        start, before, total, last = at, total, total + value, at
        if value <= 0:
            continue
        n = len(stack) - 1
        while True:
            while n >= 0 and stack[n][2] >= before:
                n = stack[n][4]
            if n < 0 or stack[n][3] >= total:
                break
            start, _, before, _, lower = stack[n]
            del stack[n:]
            n = lower
        stack.append((start, at + 1, before, total, n))
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a token."""
    for batch in batches:
        for part in chunks(batch):
            words = split_words(part.column("text"), lower=True, terms=True)
            label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            owner = words.owner()
            all_tokens = np.concatenate(tokens(words))
            text = np.tile(owner, len(BEGINNINGS) + 1)
            by = np.lexsort((text, all_tokens))
            token, text = all_tokens[by], text[by]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
            token, text = token[new], text[new]
            if not len(token):
                continue
            head = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            yield pa.RecordBatch.from_arrays(
                [signed(token[head]), pa.array(np.add.reduceat(label[text], head)), pa.array(np.add.reduceat(1 - label[text], head))], ["token", "toxic", "other"]
            )


def _greatest(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            words = split_words(part.column("text"), lower=True, terms=True)
            best = np.zeros(len(words))
            for text, segments in model.segments(words):
                best[text] = max((s[2] for s in segments), default=0.0)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(words.counts), pa.array(best)], ["label", "n_words", "best"])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton steps, with a weak ridge."""
    w = np.zeros(2)
    features = np.column_stack([x, np.ones(len(x))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        grad = features.T @ (p - y) + 1e-2 * w
        hess = (features * (p * (1 - p))[:, None]).T @ features + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    return max(float(w[0]), 0.0), float(w[1])


def train(docs: DataFrame, labels: DataFrame, allowed, limit: int = SAMPLE) -> Model:
    """Learns tokens on three folds of the sample and the calibration on the fourth."""
    sample = labelled_sample(docs, labels, "toxic", allowed, limit)
    learn, check = sample.filter("fold <> 0"), sample.filter("fold = 0")
    rows = sample.groupBy("label", (F.col("fold") != 0).alias("learn")).count().collect()
    n1, n0 = (sum(r["count"] for r in rows if r["label"] == v and r["learn"]) for v in (1, 0))
    if not n1 or not n0:
        return Model(offset=20.0 if rows and all(r["label"] == 1 for r in rows) else -20.0)
    counts = learn.select("text", "label").mapInArrow(_token_counts, "token long, toxic long, other long").groupBy("token").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    a = PRIOR * (F.col("t") + F.col("o")) / (n1 + n0)
    odds = lambda c, n: F.log((c + a) / (F.lit(n + PRIOR) - c - a))
    scored = counts.filter("t >= 3").withColumn("odds", odds(F.col("t"), n1) - odds(F.col("o"), n0))
    scored = scored.withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("o") + a)))
    top = scored.filter(F.col("z") >= SIGNIFICANT).orderBy(F.desc("z"), "token").limit(VOCABULARY).select("token", "odds").toPandas()
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(token)
    model = Model(token[by], top["odds"].to_numpy(float)[by])
    rows = check.select("text", "label").mapInArrow(lambda it: _greatest(it, model), f"label {sample.schema['label'].dataType.simpleString()}, n_words long, best double").toPandas()
    if rows["label"].nunique() < 2:
        return model
    clean = rows[(rows["label"] == 0) & (rows["best"] > 0)]
    if len(clean) >= 10:
        # beyond small scores the excess is exponential; its mean gives the rate
        model.rate = float(1 / max((clean["best"] - clean["best"].min()).mean(), 0.2))
        model.log_k = float(np.log(max(len(clean), 1) / max(rows.loc[rows["label"] == 0, "n_words"].sum(), 1)) + model.rate * clean["best"].min())
    x = model.scale(rows["best"].to_numpy(), rows["n_words"].to_numpy())
    model.slope, model.offset = _logistic(x, rows["label"].to_numpy(float))
    return model


def _score(column: pa.Array, model: Model) -> tuple[np.ndarray, list[list[dict]]]:
    words = split_words(column, lower=True, terms=True)
    best = np.zeros(len(words))
    found: list[list[dict]] = [[] for _ in range(len(words))]
    for text, segments in model.segments(words):
        best[text] = max((s[2] for s in segments), default=0.0)
        found[text] = [{"start": a, "end": b, "score": s} for a, b, s in segments if s >= SIGNIFICANT_SEGMENT]
    return model.probability(best, words.counts), found


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, segments): probability of the toxic label and all significant segments, as word offsets."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for part in chunks(batch):
                p, found = _score(part.column("text"), model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array(found, kind)], ["doc_id", "score", "segments"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double, segments array<struct<start: long, end: long, score: double>>")


def reject(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents that score below ``threshold``, all columns as they are."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array(_score(part.column("text"), model)[0] < threshold))

    return docs.mapInArrow(kept, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; documents whose id hash leaves 2 modulo 4 are never learned from."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    rest = id_remainder(4)
    out = score(docs, train(docs, labels, rest != 2))
    return out.select("doc_id", (rest == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "segments")


QUERIES = {"op9_toxicity": op9_toxicity}
