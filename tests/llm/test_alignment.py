import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from tokenizers import Tokenizer

from opslens.llm import alignment as q
from opslens.llm.bpe_automaton import byte_of_letter

TEXTS = [
    None,
    "",
    " ",
    "   two  spaces   ",
    "Hello's WORLD! <|endoftext|> <s> </s> <unk> <0x41>",
    "日本語　テキスト \U0001f600 é é",
    "a▁b",
    "▁",
    "\n\n \t x\x00y",
    "word " * 3000,
    "z" * 5000,
    "Hello's WORLD!",
    "Hello's WORLD!",
]


class Sides:
    def __init__(self):
        self.a = Tokenizer.from_file(q.tokenizer_path(q.VOCABULARY))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=q.tokenizer_path(q.PIECES))
        self.letters = byte_of_letter()

    def tokens(self, text):
        if not text:
            return [], []
        ids = self.a.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


@pytest.fixture(scope="module")
def sides():
    return Sides()


def spans(tokens):
    at, out = 0, []
    for i, label in tokens:
        out.append((i, at, at + len(label)))
        at += len(label)
    return out


def brute(texts, sides):
    rows, pairs = [], Counter()
    for text in texts:
        a, b = map(spans, sides.tokens(text))
        found, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                found.append((i, b[k][0]))
                k += 1
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, before = [], 0
        at_a = at_b = 0
        for end in ends:
            part = [[], []]
            while at_a < len(a) and a[at_a][2] <= end:
                part[0].append(str(a[at_a][0]))
                at_a += 1
            while at_b < len(b) and b[at_b][2] <= end:
                part[1].append(str(b[at_b][0]))
                at_b += 1
            groups.append("|".join(",".join(p) for p in part))
        pairs.update(found)
        rows.append((len(a), len(b), len(ends), found, ";".join(groups)))
    highest = defaultdict(int)
    for (_, b), n in pairs.items():
        highest[b] = max(highest[b], n)
    out = []
    for n_a, n_b, n_groups, found, text in rows:
        best = sum(pairs[p] == highest[p[1]] for p in found)
        out.append((n_a, n_b, n_groups, len(found), best, sum(pairs[p] for p in found), sha256(text.encode()).hexdigest() if n_a else ""))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("sizes", [(1_000_000, 4_000_000), (1000, 3000)])
def test_against_brute_force(spark, sides, monkeypatch, sizes):
    monkeypatch.setattr(q, "PART", sizes[0])
    monkeypatch.setattr(q, "BATCH", sizes[1])
    rng = random.Random(1)
    words = ["the", "Straße", "token", "é", "日本", "x1", "'s", "don't", "  ", "\n", "-", "▁", "...", "1234"]
    texts = TEXTS + [" ".join(rng.choice(words[:11] + words[12:]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in enumerate(texts)], "doc_id long, text string, batch int, links binary").repartition(3)
    found = q.align(docs)
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in found.documents().collect()}
    want = brute(texts, sides)
    assert [got[i] for i in range(len(texts))] == want
    assert found.groups().filter("doc_id = 11").first().groups.count(";") == want[11][2] - 1


def test_whole_query(spark, data, sides):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([r.doc_id for r in docs], brute([r.text for r in docs], sides)))
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in q.op11_token_alignment(spark, data).collect()}
    assert got == want


def test_side_b_in_parts(sides):
    rng = random.Random(3)
    letters = "abcdehilmnorstu  '\n.,1é日　\t"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(2000)]
    with open(q.tokenizer_path(q.PIECES), "rb") as f:
        encoder = q.PieceEncoder(f.read())
    assert encoder.parts
    raw = [(" " + t).encode() for t in texts]
    ids, first = encoder(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    assert [ids[x:y].tolist() for x, y in zip(first, first[1:])] == sides.b.encode(texts)


def test_links_are_all_overlaps():
    rng = random.Random(2)
    for _ in range(200):
        cuts = [sorted({0, *(rng.randrange(30) for _ in range(rng.randrange(12)))}) for _ in range(2)]
        a, b = [pd.DataFrame({"doc": [0] * len(c), "at": c}) for c in cuts]
        ends = [c[1:] + [30] for c in cuts]
        want = {(i, j) for i in range(len(cuts[0])) for j in range(len(cuts[1])) if cuts[0][i] < ends[1][j] and cuts[1][j] < ends[0][i]}
        got = list(q.links(a, b).itertuples(index=False, name=None))
        assert len(got) == len(set(got)) and set(got) == want


def test_empty_and_odd_ids(spark):
    docs = spark.createDataFrame([("x", "a b"), (None, "a b"), ("x", "a b"), ("y", None)], "doc_id string, text string")
    assert q.align(docs.limit(0)).documents().count() == 0
    got = sorted((r.doc_id or "", r.n_a, r.count_sum) for r in q.align(docs).documents().collect())
    assert got == [("", 2, 6), ("x", 2, 6), ("x", 2, 6), ("y", 0, 0)]
    assert q.align(docs.filter("doc_id = 'y'")).documents().count() == 1
