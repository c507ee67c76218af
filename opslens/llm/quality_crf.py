"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are binned measurements of the line and of its neighbours
(previous and next line); neighbouring labels are linked by transition weights. The field is fitted on
the lines of a bounded sample, each line taking its document's label. Forward-backward gives every
line's marginal, and their mean, weighted by line length, is the document's score.

Defined results: null, empty and blank texts have one empty line and are scored by it; lines without a
word are not lines; without labels of both kinds the score is 1 if only good documents are known
and else 0; repeated rows give one row each; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from opslens.llm.sampling import id_remainder, labelled_sample
from opslens.llm.textnum import Spans, chunks, split_words

SAMPLE = 4_000  # labelled documents to learn from, half of them of each label
MEASURES = 12
BINS = 8
PULL = 1e-3
STEPS = 150


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode())] = 1
    return out


UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = _class("0123456789")
MARK = _class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
SYMBOL = _class("#*$%&|<>{}[]\\^~=_")
SHOUT = _class("!?")
STOP = _class(".!?:;,")


@dataclass
class Lines:
    """Lines with a word of consecutive texts, at least one per text."""

    measures: np.ndarray  # lines by MEASURES
    length: np.ndarray  # bytes
    first: np.ndarray  # of each text


def lines_of(column: pa.Array) -> Lines:
    """Measures every line of a text column."""
    words = split_words(column)
    data = words.data
    n_texts = len(words)
    # a word begins a line if a newline or the text's begin stands before it
    newlines = np.concatenate([[0], np.cumsum(data == 10)])
    owner = words.owner()
    row = newlines[words.start]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(row)) - 1 if len(head) else head
    line = np.cumsum(new) - 1
    n = len(head)
    begin, end = words.start[head], words.end[tail] if n else head
    length = end - begin

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[data])])
        return (sums[end] - sums[begin]) / np.maximum(length, 1)

    n_words = tail - head + 1
    hashes = words.hashes()
    same = np.zeros(len(row))
    same[1:] = (hashes[1:] == hashes[:-1]) & ~new[1:]
    size = words.end - words.start
    by = np.lexsort((hashes, line))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (hashes[by][1:] != hashes[by][:-1]) | (line[by][1:] != line[by][:-1])
    distinct = np.bincount(line[by], fresh, n) if n else np.zeros(0)
    whole = Spans(hashes)(head, tail + 1) if n else np.zeros(0, np.uint64)
    text = owner[head]
    order = np.lexsort((np.arange(n), whole, text))
    again = np.zeros(n)
    again[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (text[order][1:] == text[order][:-1])
    per_line = lambda x: np.bincount(line, x, n) if n else np.zeros(0)
    measures = np.column_stack(
        [
            np.log1p(n_words),
            per_line(size) / np.maximum(n_words, 1),
            share(UPPER),
            share(DIGIT),
            share(MARK),
            share(SYMBOL),
            share(SHOUT),
            per_line(same) / np.maximum(n_words, 1),
            distinct / np.maximum(n_words, 1),
            again,
            STOP[data[end - 1]] if n else np.zeros(0),
            per_line(size <= 3) / np.maximum(n_words, 1),
        ]
    ).reshape(n, MEASURES)
    # a text without a line gets an empty one
    counts = np.bincount(text, minlength=n_texts)
    first = np.append(0, np.cumsum(np.maximum(counts, 1)))
    place = np.arange(n) - (np.cumsum(counts) - counts)[text] + first[text] if n else np.zeros(0, np.int64)
    out, sizes = np.zeros((int(first[-1]), MEASURES)), np.ones(int(first[-1]))
    out[place], sizes[place] = measures, length
    return Lines(out, sizes, first)


@dataclass
class Model:
    cuts: np.ndarray = field(default_factory=lambda: np.zeros((MEASURES, BINS - 1)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((3, MEASURES, BINS)))  # previous, own and next line
    links: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = 0.0

    def features(self, lines: Lines) -> np.ndarray:
        """Bin of every measure of every line and its neighbours; -1 beyond the text."""
        own = np.stack([np.searchsorted(self.cuts[m], lines.measures[:, m], side="right") for m in range(MEASURES)], 1)
        before, after = np.full_like(own, -1), np.full_like(own, -1)
        before[1:], after[:-1] = own[:-1], own[1:]
        before[lines.first[:-1]] = -1
        after[lines.first[1:] - 1] = -1
        return np.stack([before, own, after], 1)

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """Weight of good over bad for every line."""
        side, measure = np.arange(3)[None, :, None], np.arange(MEASURES)[None, None, :]
        return self.bias + np.where(features >= 0, self.weights[side, measure, features], 0.0).sum((1, 2))

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and the expected number of label pairs over all texts."""
        counts = np.diff(first)
        by = np.argsort(-counts, kind="stable")
        heads, sizes = first[:-1][by], counts[by]
        score = np.column_stack([np.zeros(len(emission)), emission])
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        longest = int(sizes[0]) if len(sizes) else 0
        # texts stand by falling number of lines, so those that go on are always the first ones
        going = np.searchsorted(-sizes, -np.arange(longest), side="left")
        for t in range(longest):
            at = heads[: going[t]] + t
            if t == 0:
                ahead[at] = score[at]
            else:
                step = ahead[at - 1][:, :, None] + self.links[None]
                ahead[at] = np.logaddexp(step[:, 0], step[:, 1]) + score[at]
        for t in range(longest - 2, -1, -1):
            at = heads[: going[t + 1]] + t
            step = self.links[None] + (score[at + 1] + back[at + 1])[:, None, :]
            back[at] = np.logaddexp(step[:, :, 0], step[:, :, 1])
        both = ahead + back
        norm = np.logaddexp(both[:, 0], both[:, 1])
        inner = np.setdiff1d(np.arange(len(emission)), first[:-1], assume_unique=True)
        pair = ahead[inner - 1][:, :, None] + self.links[None] + (score[inner] + back[inner])[:, None, :] - norm[inner][:, None, None]
        return np.exp(both[:, 1] - norm), np.exp(pair).sum(0)

    def score(self, lines: Lines) -> np.ndarray:
        p, _ = self.marginals(self.emissions(self.features(lines)), lines.first)
        total = np.add.reduceat(p * lines.length, lines.first[:-1]) / np.add.reduceat(lines.length, lines.first[:-1])
        return np.clip(total, 0.0, 1.0)


def fit(lines: Lines, label: np.ndarray, steps: int = STEPS) -> Model:
    """Penalised maximum likelihood of the lines' labels, by adaptive gradient steps."""
    cuts = np.quantile(lines.measures, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    model = Model(np.ascontiguousarray(cuts))
    features = model.features(lines)
    y = np.repeat(label, np.diff(lines.first)).astype(float)
    inner = np.setdiff1d(np.arange(len(y)), lines.first[:-1], assume_unique=True)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    n = len(y)
    here = features >= 0
    flat = (np.arange(3)[None, :, None] * MEASURES + np.arange(MEASURES)[None, None, :]) * BINS + np.maximum(features, 0)
    theta = np.zeros(3 * MEASURES * BINS + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        model.weights, model.links, model.bias = theta[:-5].reshape(3, MEASURES, BINS), theta[-5:-1].reshape(2, 2), float(theta[-1])
        p, pairs = model.marginals(model.emissions(features), lines.first)
        miss = y - p
        each = np.bincount(flat[here], np.broadcast_to(miss[:, None, None], flat.shape)[here], len(theta) - 5)
        grad = np.concatenate([each, (seen - pairs).ravel(), [miss.sum()]]) / n - PULL * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            lines = lines_of(part.column("text"))
            rows = [
                np.column_stack([lines.length[a:b], lines.measures[a:b]]).astype("<f4").tobytes() for a, b in zip(lines.first[:-1], lines.first[1:])
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label").cast(pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "label", "lines"])


def train(docs: DataFrame, labels: DataFrame, allowed: Column, limit: int = SAMPLE) -> Model:
    """Fits the field on a bounded, balanced sample; only line measures come to the driver."""
    sample = labelled_sample(docs, labels, "quality", allowed, limit, [0, 1])
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(_measured, f"doc_id {kind}, label int, lines binary").toPandas().sort_values("doc_id")
    if rows["label"].nunique() < 2:
        good = len(rows) > 0 and bool((rows["label"] == 1).all())
        return Model(bias=40.0 if good else -40.0)
    tables = [np.frombuffer(b, "<f4").reshape(-1, MEASURES + 1) for b in rows["lines"]]
    table = np.concatenate(tables).astype(float)
    return fit(Lines(table[:, 1:], table[:, 0], np.append(0, np.cumsum([len(t) for t in tables]))), rows["label"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_lines): probability that the document is good."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                lines = lines_of(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(lines)), pa.array(np.diff(lines.first))], ["doc_id", "score", "n_lines"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, score double, n_lines long")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; documents whose id hash leaves 0 modulo 5 are never learned from."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    rest = id_remainder(5)
    out = score(docs, train(docs, labels, rest != 0))
    return out.select("doc_id", (rest == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines")


QUERIES = {"op1_quality_crf": op1_quality_crf}
