"""Benchmark decontamination: every passage of every document queries an index of the test items.

The items, a small table of checked size, go into a BM25 index that block-max WAND searches; more items
than ``ITEMS_PER_INDEX`` are indexed in several blocks (document frequencies are then per block).
A passage is ``PASSAGE`` terms, half overlapping the next. Items are indexed in even pieces of at most half
a passage, so some passage holds any piece of a copy whole, however long the item is. Scores are
relative to the score of the piece queried with itself; an item is retrieved by any piece above the
threshold, none is cut off. Retrieved items are then verified whole against the words around the
passage: the word n-grams of the question and of the answer have to recur.

A benchmark row is (item_id, text); the last sentence counts as the answer, the rest as the
question, and a text of one sentence is all question. As that cut is only a guess, such an item is
also verified if the n-grams of its whole text recur. With ``question`` and ``answer`` columns those
are used, and both have to recur; an answer of at most ``NGRAM`` terms is a single n-gram, found or
not, so there the n-grams of the whole item suffice as well, and answers too short to keep half their
n-grams when one term changes are verified by shorter ones.

Defined results: null or empty texts and items match nothing; repeated items match each; repeated
documents each give their own rows; extra columns are ignored; with an empty item table no document
is touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from opslens.llm.bm25 import BlockMaxIndex
from opslens.llm.textnum import Spans, chunks, split_words

PASSAGE = 128
THRESHOLD = 0.6
OVERLAP = 0.5
NGRAM = 5
ITEMS_PER_INDEX = 1_000  # at most this many items travel with one job
MAX_ITEM_CHARS = 20_000_000  # of one block of items

SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


class Items:
    """One block of benchmark items: terms, questions, answers and the index of their pieces."""

    def __init__(self, rows: list[tuple[int, str, str]], own: bool = False):
        self.own = own  # the table tells questions and answers apart
        self.ids = [r[0] for r in rows]
        both = [t for _, question, answer in rows for t in (question, answer)]
        words = split_words(pa.array(both, pa.string()), lower=True, terms=True)
        hashes = words.hashes()
        parts = np.split(hashes, words.first[1:-1]) if both else []
        self.questions, self.answers = parts[0::2], parts[1::2]
        self.terms = [np.concatenate(p) for p in zip(self.questions, self.answers)]
        cut = [np.array_split(t, max(-(-len(t) // (PASSAGE // 2)), 1)) for t in self.terms]
        self.owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])  # item of each piece
        self.index = BlockMaxIndex([piece for c in cut for piece in c])

    def verified(self, item: int, around: np.ndarray, overlap: float) -> tuple[float, float] | None:
        """Shares of the question's and of the answer's n-grams found in ``around``; None if they do not verify the item."""
        question, answer = self.questions[item], self.answers[item]
        # of L - n + 1 n-grams a changed term takes n at most
        n = max(min(NGRAM, (len(answer) + 1) // 3), 1) if self.own else NGRAM
        shares = _share(question, around), _share(answer, around, n)
        whole = not self.own or len(answer) <= NGRAM
        return shares if min(shares) >= overlap or (whole and _share(self.terms[item], around) >= overlap) else None


def _share(part: np.ndarray, around: np.ndarray, n: int = NGRAM) -> float:
    """Share of the distinct n-grams of ``part`` that ``around`` has; 1 for nothing."""
    if not len(part):
        return 1.0
    n = min(n, len(part))
    return float(np.isin(np.unique(_grams(part, n)), _grams(around, n)).mean())


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    at = np.arange(max(len(hashes) - n + 1, 0))
    return Spans(hashes)(at, at + n)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item text."""
    parts = SENTENCE_END.split(text.strip())
    return (text, "") if len(parts) < 2 else (text.strip()[: -len(parts[-1])], parts[-1])


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Items in blocks of bounded size."""
    own = {"question", "answer"} <= set(benchmark.columns)
    rows = benchmark.select("item_id", "question", "answer") if own else benchmark.select("item_id", "text")
    block, chars = [], 0
    for row in rows.orderBy("item_id").toLocalIterator():
        question, answer = (row[1] or "", row[2] or "") if own else split_item(row[1] or "")
        if block and (len(block) >= ITEMS_PER_INDEX or chars + len(question) + len(answer) > MAX_ITEM_CHARS):
            yield Items(block, own)
            block, chars = [], 0
        block.append((row[0], question, answer))
        chars += len(question) + len(answer)
    if block:
        yield Items(block, own)


def find(column: pa.Array, items: Items, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> Iterator[tuple[int, int, float, float, float, int]]:
    """(text, item, score, question share, answer share, first term) of every verified pair in a text column."""
    words = split_words(column, lower=True, terms=True)
    hashes = words.hashes()
    term = items.index.lookup(hashes)
    half = PASSAGE // 2
    # half-passage number of each word; a passage is two consecutive halves of one text
    counts = words.counts
    halves = -(-counts // half)
    base = np.cumsum(halves) - halves
    owner = words.owner()
    place = base[owner] + (np.arange(len(hashes)) - words.first[owner]) // half
    known = np.flatnonzero(term >= 0)
    if not len(known):
        return
    n_terms = len(items.index.terms)
    starts = np.zeros(int(halves.sum()) + 1, bool)
    starts[base[counts > 0]] = True
    now, before = place[known], place[known] - 1
    inside = ~starts[now]
    passage = np.concatenate([now, before[inside]])
    key = np.unique(passage * n_terms + np.concatenate([term[known], term[known][inside]]))
    passage, terms = key // n_terms, key % n_terms
    best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    hits: dict[tuple[int, int], float] = {}
    for p, piece, score in items.index.search_many(passage, terms, threshold):
        hit = p, int(items.owner[piece])
        hits[hit] = max(score, hits.get(hit, 0.0))
    for (p, item), score in hits.items():
        text = int(np.searchsorted(base, p, side="right")) - 1
        first = int(words.first[text]) + (p - int(base[text])) * half
        reach = len(items.terms[item])
        around = hashes[max(first - reach, words.first[text]) : min(first + PASSAGE + reach, words.first[text + 1])]
        shares = items.verified(item, around, overlap)
        if shares and score > best.get((text, item), (-1.0,))[0]:
            best[text, item] = (score, *shares, first - int(words.first[text]))
    for (text, item), found in sorted(best.items()):
        yield text, item, *found


def _pairs(batches: Iterator[pa.RecordBatch], items: Items, threshold: float, overlap: float, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            rows = list(find(part.column("text"), items, threshold, overlap))
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [part.column("doc_id").take(at), pa.array([items.ids[r[1]] for r in rows], id_type)]
            columns += [pa.array([r[i] for r in rows], pa.float64()) for i in (2, 3, 4)]
            columns.append(pa.array([r[5] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_term"])


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and item that is verified in it, with the score and place of the best passage and piece."""
    texts = docs.select("doc_id", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    item = benchmark.schema["item_id"].dataType
    id_type = to_arrow_type(item)
    schema = f"doc_id {kind}, item_id {item.simpleString()}, score double, question_overlap double, answer_overlap double, first_term long"
    out = None
    for items in item_blocks(benchmark):
        one = texts.mapInArrow(lambda it, items=items: _pairs(it, items, threshold, overlap, id_type), schema)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _clean(batches: Iterator[pa.RecordBatch], items: Items, threshold: float, overlap: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            keep = np.ones(len(part), bool)
            keep[[r[0] for r in find(part.column("text"), items, threshold, overlap)]] = False
            yield part.filter(pa.array(keep))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The documents in which no item is verified, all columns as they are."""
    for items in item_blocks(benchmark):
        docs = docs.mapInArrow(lambda it, items=items: _clean(it, items, threshold, overlap), docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified pairs of documents and benchmark items."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return contaminated_pairs(docs, benchmark)


QUERIES = {"op7_decontaminate": op7_decontaminate}
