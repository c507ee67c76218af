import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from opslens.llm import bpe as q
from opslens.llm.bpe_automaton import Automaton

TEXTS = [
    None,
    "",
    "Hello's WORLD! it's 1234 we'll 'sabc ''s 's's don't x're",
    "a  b   c \n\n d\t\te  ",
    "   ",
    "\n",
    "<|endoftext|>",
    "x <|endoftext|><|endoftext|> y<|endof text|>  <|endoftext|>",
    "日本語　テキスト １２  x y \u0085z",
    "word " * 9000,
    "a" * 20_000,
    "ab" * 3000 + "é" * 500,
    "\x00\x01 \x7f",
    "Hello's WORLD!",
    "Hello's WORLD!",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(q.tokenizer_path(q.VOCABULARY))


def rows_of(texts, library):
    out = []
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    return out


def ids_of(texts, special=True):
    automaton, split = q.compiled(q.tokenizer_path(q.VOCABULARY))
    ids, first = q.encode_texts(automaton, split, *q.text_buffers(pa.array(texts, pa.string())), special)
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


def test_ids_and_texts_as_the_library_gives_them(spark, library):
    docs = spark.createDataFrame([(i, t, 7, b"x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int, ids binary").repartition(3)
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.text) for r in q.decode(q.encode(docs)).collect())
    assert got == rows_of(TEXTS, library)


def test_query_against_the_library(spark, data, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = q.op13_bpe(spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("letters", ["abcdehilmnorstu '\n.,1é日 ", "ab ", "-=_ \n\r\t", "'stmdrevl ", "　  x१²ǅʼ́\U0001f600"])
def test_random_texts(letters, library):
    rng = random.Random(letters)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 120))) for _ in range(800)]
    assert ids_of(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_any_characters(library):
    rng = random.Random(5)
    ranges = [(0, 0x250), (0x250, 0x3000), (0x3000, 0xD800), (0xE000, 0x20000), (0x20000, 0x110000)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(0, 30))) for _ in range(1500)]
    assert ids_of(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_strings_as_plain_text(library):
    library.encode_special_tokens = True
    try:
        texts = [t or "" for t in TEXTS]
        assert ids_of(texts, special=False) == [library.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        library.encode_special_tokens = False


def by_merges(word, merges):
    """Applies every merge in its order to the whole word."""
    ids = list(word)
    for u, v, t in merges:
        out = []
        for x in ids:
            if out and out[-1] == u and x == v:
                out[-1] = t
            else:
                out.append(x)
        ids = out
    return ids


def test_random_merges_accept_one_sequence():
    rng = random.Random(2)
    for _ in range(60):
        labels, merges = [b"a", b"b", b"c"], []
        while len(merges) < 14:
            u, v = rng.randrange(len(labels)), rng.randrange(len(labels))
            if labels[u] + labels[v] not in labels:
                merges.append((u, v, len(labels)))
                labels.append(labels[u] + labels[v])
        machine = Automaton(labels, merges, {})
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 16))) for _ in range(60)]
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words])
        ids, n = machine.pieces(data, end - [len(w) for w in words], end)
        at = np.append(0, np.cumsum(n))
        for k, word in enumerate(words):
            want = by_merges([b"abc".index(x) for x in word], merges)
            assert ids[at[k] : at[k + 1]].tolist() == want == machine.long_piece(word)


def test_long_pieces_and_odd_ids(spark, library):
    text = "z" * 300_000 + "é" * 1000
    assert ids_of([text]) == [library.encode(text, add_special_tokens=False).ids]
    odd = spark.createDataFrame([("x", 2, np.array([90_000, 464], "<u4").tobytes()), (None, 1, np.array([100], "<u4").tobytes())], "doc_id string, n_tokens long, ids binary")
    want = library.decode([464], skip_special_tokens=False)
    assert [(r.doc_id, r.text) for r in q.decode(odd).collect()] == [("x", want), (None, library.decode([100], skip_special_tokens=False))]


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id int, text string")
    assert q.encode(docs.limit(0)).count() == 0
    assert [r.n_tokens for r in q.encode(docs).collect()] == [2, 2, 2]
