import random

import numpy as np
import pyarrow as pa

from opslens.llm import decontaminate as q
from opslens.llm.bm25 import B, K1, BlockMaxIndex


def scores(items, query):
    """Relative BM25 of every item, term by term."""
    n = len(items)
    mean = np.mean([len(t) for t in items])
    df = {}
    for t in items:
        for w in set(t.tolist()):
            df[w] = df.get(w, 0) + 1

    def impact(w, t):
        tf = int((t == w).sum())
        return np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean))

    return [sum(impact(w, t) for w in set(query.tolist()) & set(t.tolist())) / sum(impact(w, t) for w in set(t.tolist())) for t in items]


def test_search_finds_all_above_threshold():
    rng = np.random.default_rng(1)
    items = [rng.zipf(1.5, rng.integers(3, 40)).clip(max=80).astype(np.uint64) for _ in range(67)]
    index = BlockMaxIndex(items)
    queries = [np.concatenate([items[i][: rng.integers(1, 40)], rng.zipf(1.4, 20).clip(max=90).astype(np.uint64)]) for i in range(67)]
    rows = [np.unique(index.lookup(x)) for x in queries]
    rows = [r[r >= 0] for r in rows]
    query = np.repeat(np.arange(67), [len(r) for r in rows])
    for threshold in (0.3, 0.6, 0.9):
        got = {(a, b): s for a, b, s in index.search_many(query, np.concatenate(rows), threshold)}
        true = {(i, j): s for i, x in enumerate(queries) for j, s in enumerate(scores(items, x))}
        assert set(got) == {k for k, s in true.items() if s >= threshold}
        assert all(abs(got[k] - true[k]) < 1e-9 for k in got)


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))


def sentence(rng, n):
    return (" ".join(["the", "of"][rng.randrange(2)] if rng.random() < 0.4 else word(rng) for _ in range(n)) + ".").capitalize()


def test_planted_items(spark):
    rng = random.Random(7)
    bench = [(i, sentence(rng, rng.randrange(8, 40)) + " " + sentence(rng, rng.randrange(3, 20))) for i in range(60)] + [(60, None), (61, ""), (62, bench_one := sentence(rng, 12))]
    bench.append((63, bench[5][1]))
    docs, true = [(0, None), (1, ""), (2, bench[3][1].upper()), (3, bench_one)], {(2, 3), (3, 62)}
    for i in range(10, 150):
        parts = [sentence(rng, rng.randrange(5, 60)) for _ in range(rng.randrange(1, 40))]
        if i % 2:
            j = rng.randrange(60)
            parts.insert(rng.randrange(len(parts) + 1), bench[j][1])
            true |= {(i, j)} | ({(i, 63)} if j == 5 else set())
        docs.append((i, "\n".join(parts)))
    docs.append((200, ("filler words go on " * 30_000) + bench[7][1]))
    true.add((200, 7))
    table = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in q.contaminated_pairs(table, items).collect()}
    assert got == true
    kept = q.without_contaminated(table, items)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in true}
    own = items.selectExpr("item_id", "text AS question", "'no such answer in any text' AS answer")
    assert q.contaminated_pairs(table, own).count() == 0


def test_long_items():
    rng = random.Random(11)
    lengths = [60, 64, 65, 100, 128, 129, 150, 250, 300, 400, 600, 1000]
    bench = [(i, " ".join(sentence(rng, 10) for _ in range(n // 10)) + " " + sentence(rng, 3 + n % 10), "") for i, n in enumerate(lengths)]
    items = q.Items(bench)
    for shift in (0, 1, 37, 63, 64, 100):
        texts = [" ".join(word(rng) for _ in range(shift)) + " " + text + " " + sentence(rng, 90) for _, text, _ in bench]
        texts += [" ".join(text.split()[: len(text.split()) // 3]) for _, text, _ in bench]
        got = {(r[0], r[1]) for r in q.find(pa.array(texts), items)}
        assert got == {(i, i) for i in range(len(bench))}


def test_short_answers():
    rng = random.Random(12)
    question = [" ".join(sentence(rng, 15) for _ in range(2)) for _ in range(6)]
    answer = ["Q.", "Two three.", "One two three four five.", "One two three four five six seven.", "", "No such answer in any text."]
    changed = ["R.", "Two four.", "One two nine four five.", "One two three nine five six seven.", "", "Quite another one stands here instead."]
    rows = list(zip(range(6), question, answer))
    without = pa.array([f"{sentence(rng, 20)} {a} {sentence(rng, 20)}" for a in question])
    other = pa.array([f"{sentence(rng, 20)} {a} {b} {sentence(rng, 20)}" for a, b in zip(question, changed)])
    apart = pa.array([f"{sentence(rng, 20)} {a} and the answer is {b} {sentence(rng, 20)}" for a, b in zip(question, answer)])
    for texts in (without, other, apart):
        assert {(r[0], r[1]) for r in q.find(texts, q.Items(rows))} == {(i, i) for i in range(6)}
    # columns of their own: a long answer has to recur, be it with one term changed
    assert {(r[0], r[1]) for r in q.find(without, q.Items(rows, own=True))} == {(i, i) for i in (0, 1, 2, 4)}
    assert {(r[0], r[1]) for r in q.find(other, q.Items(rows, own=True))} == {(i, i) for i in range(5)}
    assert {(r[0], r[1]) for r in q.find(apart, q.Items(rows, own=True))} == {(i, i) for i in range(6)}
    half = pa.array([" ".join(a.split()[:8]) + " " + sentence(rng, 40) for a in question])
    assert not list(q.find(half, q.Items(rows))) and not list(q.find(half, q.Items(rows, own=True)))


def test_item_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i}") for i in range(25)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha3 beta3 gamma3 delta3 eps3 y"), (2, "alpha24 beta24 gamma24 delta24 eps24")], "doc_id long, text string")
    monkeypatch.setattr(q, "ITEMS_PER_INDEX", 10)
    assert {(r.doc_id, r.item_id) for r in q.contaminated_pairs(docs, items).collect()} == {(1, 3), (2, 24)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert q.contaminated_pairs(docs, none).count() == 0 and q.without_contaminated(docs, none).count() == 1
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert q.contaminated_pairs(docs.limit(0), items).count() == 0


def test_item_ids_of_any_type(spark):
    text = "the quick brown fox jumps over the lazy dog near the old river bank today. It was seen there by nine people."
    docs = spark.createDataFrame([("d1", "before " + text + " after"), ("d2", "nothing of it"), (None, text)], "doc_id string, text string")
    for kind, name in (("string", "item-a"), ("int", 7)):
        items = spark.createDataFrame([(name, text)], f"item_id {kind}, text string")
        found = q.contaminated_pairs(docs, items)
        assert dict(found.dtypes)["item_id"] == kind
        assert sorted((r.doc_id or "", r.item_id) for r in found.collect()) == [("", name), ("d1", name)]
