import random
import re

import numpy as np
import pytest

from opslens.llm import components as c
from opslens.llm import ngram_join as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, k=5):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def run(spark, rows, block=q.BLOCK):
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, n int, rep int, set_id int").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in q.near_duplicates(docs, block=block).collect()}


@pytest.mark.parametrize("block", [7, 1000])
def test_against_brute_force(spark, block):
    rng = random.Random(1)
    vocab = [f"W{i}" for i in range(300)] + ["Ä", "ä"]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A\tb"), (5, "b a"), (6, "x " * 900), (7, "x " * 5), (8, "x x x x")]
    i = 10
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(40, 120))]
        for _ in range(rng.randrange(1, 14)):
            # a random walk of edits: linked in chains, not all with each other
            for _ in range(rng.randrange(2)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            rows.append((i, " ".join(base)))
            i += 1
    line = "one common line that stands in very many documents of the table"
    rows += [(i + j, line + " " + " ".join(rng.choice(vocab) for _ in range(j % 12))) for j in range(60)]
    rng.shuffle(rows)
    expected = by_hand(rows)
    assert run(spark, rows, block) == expected
    assert len({v[1] for v in expected.values()}) < len(rows) - 40


def test_empty_table(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, None)]) == {1: (0, 1)}


def test_tree_bounds():
    rng = np.random.default_rng(3)
    order = [np.sort(rng.choice(200, rng.integers(1, 60), replace=False)).astype(np.uint64) for _ in range(80)]
    probe = np.sort(rng.choice(200, 60, replace=False)).astype(np.uint64)
    true = np.array([len(np.intersect1d(s, probe)) for s in order])
    tree = q.PrefixTree(order)
    for least in (0, 5, 15):
        for wanted in (np.arange(80), rng.choice(80, 30, replace=False)):
            assert sorted(tree.reaching(probe, wanted, np.full(len(wanted), least))) == sorted(wanted[true[wanted] >= least].tolist())


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 600)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component_id for r in c.smallest_member(c.components(spark.createDataFrame(edges, "a long, b long"))).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}


def test_shared_line_ties_nothing(spark, monkeypatch):
    """A line that no batch holds twice is not in the table of frequent shingles; unlike texts must not meet over it."""
    rng = random.Random(3)
    line = [f"line{i}" for i in range(24)]
    rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(100)] + line)) for i in range(q.SMALL + 8)]
    rows += [(i + 1000, t + " end") for i, t in rows[:3]]
    kept, saved = {}, q._saved

    def spy(df, label):
        kept[label] = saved(df, label)
        return kept[label]

    monkeypatch.setattr(q, "_saved", spy)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in q.near_duplicates(docs).collect()}
    assert out == by_hand(rows)
    assert kept["large"].count() == 0
    assert kept["members"].count() == 6
