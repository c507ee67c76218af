"""Words of many texts as numpy arrays, straight from Arrow buffers.

A word is ``[^\\x20\\x09-\\x0D]+``. All of these separators are single bytes in UTF-8, so texts are
handled as bytes. Words and runs of words get 64-bit hashes: a polynomial over bytes (or word
hashes) read off prefix sums, then mixed. Two independent multipliers give 128 bits where needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
# bytes of text handled at once inside a task; a longer single text is handled alone
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
# for plain terms: ASCII letters and digits, and everything beyond ASCII
_NO_TERM = np.ones(256, bool)
_NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


# powers of each multiplier and of its inverse modulo 2**64, as many as a text needed so far
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``size`` powers of a multiplier and of its inverse."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < size:
        out = []
        for base in (ODD[which], pow(ODD[which], -1, 1 << 64)):
            p = np.full(max(size, CHUNK_BYTES + 1), base, U64)
            p[:1] = 1
            out.append(np.cumprod(p, dtype=U64))
        have = out[0], out[1]
        if size <= CHUNK_BYTES + 1:
            _POWERS[which] = have
    return have


class Spans:
    """Hashes of arbitrary spans of a sequence in constant time each."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values) + 1
        self.inverse = powers(which, n)[1]
        sums = np.zeros(n, U64)
        np.cumsum((values.astype(U64) + U64(1)) * powers(which, n)[0][: n - 1], out=sums[1:])
        self.sums = sums

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


@dataclass
class Words:
    """Words of consecutive texts. ``first[i]:first[i + 1]`` are the words of text i."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of each text in data
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Text index of each word."""
        return np.repeat(np.arange(len(self)), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        return Spans(self.data, which)(self.start, self.end)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions of all k-word windows, and where each text's windows begin among them."""
        counts = np.maximum(self.counts - k + 1, 0)
        first = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=first[1:])
        start = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], counts)
        return start, first


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array, lower: bool = False, terms: bool = False) -> Words:
    """Words of a text column; ``lower`` maps A-Z only, ``terms`` also splits at punctuation."""
    data, offsets = buffers(column)
    if lower:
        data = LOWER[data]
    blank = (_NO_TERM if terms else _SPACE)[data]
    word = ~blank
    begins, ends = word.copy(), word.copy()
    begins[1:] &= blank[:-1]
    ends[:-1] &= blank[1:]
    # texts stand back to back, so words also break where a text begins
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= word[inner]
    ends[inner - 1] |= word[inner - 1]
    start = np.flatnonzero(begins)
    return Words(data, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text, or one row."""
    _, offsets = buffers(batch.column(text)) if len(batch) else (None, np.zeros(1, np.int64))
    at = 0
    while at < len(batch):
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), len(batch))
        yield batch.slice(at, end - at)
        at = end


def shingle_hashes(words: Words, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word window in text order, and where each text's windows begin."""
    start, first = words.windows(k)
    return Spans(words.hashes(which), which)(start, start + k), first


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
