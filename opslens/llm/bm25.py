"""BM25 inverted index over a bounded item table, searched by block-max WAND."""

from __future__ import annotations

import numpy as np

K1, B = 1.2, 0.75
BLOCK = 8
EPS = 1e-6


class BlockMaxIndex:
    """Postings of items by term. Impacts are divided by the score of the item queried with itself.

    ``items`` holds each item's terms as 64-bit hashes. Items are numbered by length inside, so that
    the ``BLOCK`` items of a block are alike and the greatest impact of a term in a block is a close
    bound. ``bounds[t, b]`` is that impact; a search first sums bounds of whole blocks for many
    queries at once and walks the postings only in blocks that can reach the threshold.
    """

    def __init__(self, items: list[np.ndarray]):
        lengths = np.array([len(t) for t in items], float)
        self.own_number = np.argsort(lengths, kind="stable")
        items, lengths = [items[i] for i in self.own_number], lengths[self.own_number]
        n = len(items)
        self.blocks = -(-n // BLOCK)
        pairs = [np.unique(t, return_counts=True) for t in items]
        term = np.concatenate([p[0] for p in pairs] or [np.zeros(0, np.uint64)])
        count = np.concatenate([p[1] for p in pairs] or [np.zeros(0)])
        item = np.repeat(np.arange(n), [len(p[0]) for p in pairs])
        self.terms, index, df = np.unique(term, return_inverse=True, return_counts=True)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = lengths.mean() if n else 1.0
        impact = idf[index] * count * (K1 + 1) / (count + K1 * (1 - B + B * lengths[item] / max(mean, EPS)))
        impact = impact / np.maximum(np.bincount(item, impact, n), EPS)[item]
        by = np.lexsort((item, index))
        self.item, self.impact = item[by], impact[by]
        self.first = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        self.bounds = np.zeros((len(self.terms), self.blocks), np.float32)
        np.maximum.at(self.bounds, (index, item // BLOCK), impact)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each hash, -1 if no item has it."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def search_many(self, query: np.ndarray, term: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
        """(query, item, score) of every item that reaches ``threshold``, for rows (query, distinct term) sorted by query."""
        if not len(query):
            return []
        head = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        ends = np.append(head[1:], len(query))
        reach = np.add.reduceat(self.bounds[term], head, axis=0)
        out = []
        for q, block in zip(*np.nonzero(reach >= threshold - EPS)):
            for item, score in self._walk(term[head[q] : ends[q]], int(block), threshold):
                out.append((int(query[head[q]]), int(self.own_number[item]), score))
        return out

    def _walk(self, terms: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
        """WAND over the postings of one block: only pivots that the remaining lists' bounds allow are scored."""
        lists = []
        for t in terms[self.bounds[terms, block] > 0].tolist():
            a, b = int(self.first[t]), int(self.first[t + 1])
            lo, hi = np.searchsorted(self.item[a:b], [block * BLOCK, (block + 1) * BLOCK])
            lists.append([int(self.item[a + lo]), a + int(lo), a + int(hi), float(self.bounds[t, block])])
        out = []
        while lists:
            lists.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for cursor in lists:
                bound += cursor[3]
                if bound >= threshold - EPS:
                    pivot = cursor[0]
                    break
            if pivot < 0:
                break
            score, left = 0.0, []
            for cursor in lists:
                item, at, end, most = cursor
                while item < pivot and at + 1 < end:
                    at += 1
                    item = int(self.item[at])
                if item == pivot:
                    score += float(self.impact[at])
                    at += 1
                    item = int(self.item[at]) if at < end else pivot
                if at < end and item > pivot:
                    left.append([item, at, end, most])
            if score >= threshold - EPS:
                out.append((pivot, score))
            lists = left
        return out
