import zlib

import numpy as np
from tokenizers import Tokenizer

from opslens.llm import packing as q

TEXTS = [None, "", " \n\t", "Hello's WORLD! it's 1234", "é É é a b c\x1cd <|endoftext|> x", "word " * 9000, "a" * 20_000, "日本語 テキスト", "Hello's WORLD! it's 1234"]


def ids_of(text):
    t = Tokenizer.from_file(q.tokenizer_path())
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, texts, length):
    stream = {}
    for i, text in texts:
        ids = ids_of(text)
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and bytes(r.ids) == part
            assert r.boundary == (r.length < len(ids))
            stream[r.sequence_id, r.offset] = r.length
            at += r.length
        assert at == len(ids)
    total = sum(stream.values())
    assert len(stream) == len(rows)
    expected = 0
    for (sequence, offset), n in sorted(stream.items()):
        assert sequence * length + offset == expected and offset + n <= length
        expected += n
    assert expected == total


def test_round_trip(spark):
    texts = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, n int, place int").repartition(4)
    for length in (64, q.LENGTH):
        pieces = q.pack(docs, length, with_ids=True)
        check(pieces.collect(), texts, length)
    whole = q.sequences(pieces).collect()
    assert all(r.n_tokens * 4 == len(r.ids) for r in whole) and sorted(r.n_tokens for r in whole)[1:] == [q.LENGTH] * (len(whole) - 1)


def test_cache_limit(spark, monkeypatch):
    encode = q.WordEncoder(q.tokenizer_path())
    monkeypatch.setattr(q, "CACHE", 3)
    import pyarrow as pa

    texts = ["a b c d e", "f a g b", "", "a"]
    for _ in range(3):
        ids, first = encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [ids_of(t) for t in texts]


def test_plain_words_as_the_tokenizer_codes_them():
    import random

    import pyarrow as pa

    rng = random.Random(1)
    letters = [chr(c) for c in range(33, 384)] + ["'re", "'S", "'ll", "THE", "ß", "é", "e\u0301", "İ", "Σ", "１", "\u200b", "日", "ǅ"]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(200)) for _ in range(60)]
    ids, first = q.WordEncoder(q.tokenizer_path())(pa.array(texts))
    for text, a, b in zip(texts, first, first[1:]):
        assert ids[a:b].tolist() == ids_of(text)


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert q.pack(docs.limit(0)).count() == 0
    assert sorted((r.offset, r.length) for r in q.pack(docs).collect()) == [(0, 3), (3, 3)]
