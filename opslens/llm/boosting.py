"""Gradient boosted trees over binned features, fitted by histograms: of arrays, or of a table that Spark sums them over."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame

UNIT = float(1 << 24)  # gradients are summed as whole numbers of this fraction, so that the order of the rows does not matter
REWRITE = 10  # rounds after which the scores of a table are brought up to date
Block = dict[str, np.ndarray]


@dataclass
class BoostedTrees:
    """Logistic boosting of trees of fixed depth over binned features."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 16
    ridge: float = 1.0
    cuts: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    # per tree and inner node: feature and bin; per tree and leaf: value
    splits: np.ndarray | None = None
    leaves: np.ndarray | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1) if len(self.cuts) else np.zeros((len(x), 0), int)

    def start(self, share: float) -> None:
        """No tree yet, for a table with that share of positives."""
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        inner = (1 << self.depth) - 1
        self.splits, self.leaves = np.zeros((self.rounds, inner, 2), int), np.zeros((self.rounds, inner + 1))

    def node(self, b: np.ndarray, t: int, level: int) -> np.ndarray:
        """The node of that level of tree ``t`` that each row falls into."""
        rows, node = np.arange(len(b)), np.zeros(len(b), int)
        for up in range(level):
            own = self.splits[t, (1 << up) - 1 + node]
            node = node * 2 + (b[rows, own[:, 0]] > own[:, 1])
        return node

    def score(self, b: np.ndarray, f: np.ndarray, first: int, end: int) -> np.ndarray:
        """``f`` moved on by the trees from ``first`` to before ``end``."""
        for t in range(first, end):
            f = f + self.leaves[t][self.node(b, t, self.depth)]
        return f

    def sums(self, b: np.ndarray, f: np.ndarray, y: np.ndarray, n: np.ndarray, t: int, level: int) -> np.ndarray:
        """Gradients and curvatures of ``n`` rows each, by node of the level, feature and bin."""
        p = 1 / (1 + np.exp(-f))
        width, wide, size = 1 << level, b.shape[1], self.bins + 2
        at = ((self.node(b, t, level)[:, None] * wide + np.arange(wide)) * size + b).ravel()
        values = (np.rint((y - p) * UNIT) * n, np.rint(p * (1 - p) * UNIT) * n)
        return np.stack([np.bincount(at, np.repeat(v, wide), width * wide * size) for v in values]).reshape(2, width, wide, size)

    def grow(self, sums: np.ndarray, t: int, level: int) -> None:
        """The best splits of a level of tree ``t``; the leaves too behind the last one."""
        width, size = 1 << level, self.bins + 2
        gs, hs = sums.cumsum(3) / UNIT
        gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
        gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
        flat = gain.reshape(width, -1)
        best = flat.argmax(1)
        at = np.arange(width)
        split = (flat[at, best] > 1e-6)[:, None]
        own = np.where(split, np.column_stack([best // size, best % size]), [0, size - 1])
        self.splits[t, width - 1 : 2 * width - 1] = own
        if level == self.depth - 1:
            g, h = gs[at, own[:, 0], own[:, 1]], hs[at, own[:, 0], own[:, 1]]
            g, h = np.stack([g, gt[:, 0, 0] - g], 1), np.stack([h, ht[:, 0, 0] - h], 1)
            self.leaves[t] = (self.rate * g / (h + self.ridge)).ravel()

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Trees of arrays."""
        self.cuts = [np.unique(c) for c in np.quantile(x, self.quantiles(), axis=0).T]
        b, n = self.binned(x), np.ones(len(y))
        self.start(y.mean())
        f = np.full(len(y), self.base)
        for t in range(self.rounds):
            for level in range(self.depth):
                self.grow(self.sums(b, f, y, n, t, level), t, level)
            f = self.score(b, f, t, t + 1)
        return self

    def quantiles(self) -> list[float]:
        return np.linspace(0, 1, self.bins + 1)[:-1].tolist()

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        f = np.full(len(x), self.base)
        if self.splits is not None and len(x):
            f = self.score(self.binned(x), f, 0, self.rounds)
        return 1 / (1 + np.exp(-f))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one row, for the arrays of a block."""
    for batch in batches:
        if len(batch):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])


def fit_folds(cells: DataFrame, wide: int, models: list[BoostedTrees], last: Callable[[Block], np.ndarray]) -> np.ndarray:
    """Fit model ``m`` to the rows of ``cells`` whose fold is not ``m``, all models side by side.

    ``cells`` has bins (binary, ``wide`` bytes), y, fold, n (how many rows are alike) and other numbers, and the models
    their cuts and start. A level of all models' trees is one sum over all of ``cells``; the driver sees sums only, as
    many as features and bins ask for. Returned is the sum of ``last`` over all blocks: arrays by column, and ``scores`` by model.
    """

    def unpacked(row) -> Block:
        batch = pa.ipc.open_stream(row[0]).read_next_batch()
        block = {c: np.asarray(batch.column(c)) for c in batch.schema.names if c != "bins"}
        block["bins"] = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, wide)
        block["scores"] = [np.full(len(batch), m.base) for m in models]
        return block

    def moved(first: int, end: int) -> Callable[[Block], Block]:
        return lambda block: {**block, "scores": [m.score(block["bins"], f, first, end) for m, f in zip(models, block["scores"])]}

    def summed(first: int, t: int, level: int) -> Callable[[Block], np.ndarray]:
        def run(block: Block) -> np.ndarray:
            out = []
            for m, model in enumerate(models):
                own = block["fold"] != m
                b, y, n = (block[c][own] for c in ("bins", "y", "n"))
                out.append(model.sums(b, model.score(b, block["scores"][m][own], first, t), y, n, t, level))
            return np.stack(out).astype(np.int64)

        return run

    # the blocks are used by every level; scores are kept with them, a few trees behind
    data = cells.mapInArrow(_packed, "block binary").rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)
    first, rounds, before = 0, models[0].rounds, None
    for t in range(rounds):
        if t - first == REWRITE:
            before, data = data, data.map(moved(first, t)).persist(StorageLevel.MEMORY_AND_DISK)
            first = t
        for level in range(models[0].depth):
            for model, sums in zip(models, data.map(summed(first, t, level)).treeReduce(np.add)):
                model.grow(sums, t, level)
        if before is not None:
            before.unpersist()
            before = None
    total = data.map(moved(first, rounds)).map(last).treeReduce(np.add)
    data.unpersist()
    return total
