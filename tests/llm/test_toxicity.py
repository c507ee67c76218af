import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from opslens.llm import toxicity as q
from opslens.llm.textnum import split_words

BAD = ["vile", "rotten", "nasty", "awful"]


def by_hand(place, gain):
    """Maximal segments by definition: the best segment, then the same left and right of it."""
    score = {}
    n = (place[-1] + 1) if place else 0
    values = [-q.DRIFT] * n
    for p, g in zip(place, gain):
        values[p] = g

    def split(a, b):
        best = max(((sum(values[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best and best[0] > 1e-12:
            _, _, _, i, j = best
            score[i, j] = best[0]
            split(a, i)
            split(j, b)

    split(0, n)
    return score


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(150):
        place = sorted(rng.sample(range(24), rng.randrange(1, 10)))
        gain = [round(rng.uniform(-1, 2), 3) + 0.0001 * i for i, _ in enumerate(place)]
        got = {(a, b): s for a, b, s in q.maximal_segments(place, gain)}
        true = by_hand(place, gain)
        assert set(got) == set(true) and all(abs(got[k] - true[k]) < 1e-9 for k in got)


def by_rescanning(place, gain):
    """The same segments with a look at the whole stack for each hit."""
    stack, total, last = [], 0.0, -1
    for at, value in zip(place, gain):
        total -= q.DRIFT * (at - last - 1)
        start, before, total, last = at, total, total + value, at
        while value > 0 and (lower := [n for n, s in enumerate(stack) if s[2] < before]) and stack[lower[-1]][3] < total:
            start, before = stack[lower[-1]][0], stack[lower[-1]][2]
            del stack[lower[-1] :]
        if value > 0:
            stack.append((start, at + 1, before, total))
    return [(a, b, after - before) for a, b, before, after in stack]


def test_many_hits_take_linear_time():
    rng = random.Random(7)
    for _ in range(300):
        place = sorted(rng.sample(range(900), rng.randrange(1, 300)))
        gain = [rng.uniform(-2, rng.choice([1, 3, 30])) for _ in place]
        assert q.maximal_segments(place, gain) == by_rescanning(place, gain)
    # totals that fall, rise and swing
    for step, values in ((40, [1.0]), (1, [1.0]), (7, [3.0, 0.5, -2.0, 9.0]), (3, [0.1, 2.0])):
        place = list(range(0, step * 100_000, step))
        began = time.process_time()
        q.maximal_segments(place, (values * 100_000)[:100_000])
        assert time.process_time() - began < 2


def corpus():
    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in "pqrst" for b in ("an", "el", "or", "ix", "um")]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 120))]
        toxic = i % 5 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(BAD) for _ in range(4)]
        docs.append((i, " ".join(words), "clash", 0.5))
        labels.append((i, int(toxic)))
    docs += [(1000, None, "", 0.0), (1001, "", "", 0.0), (1002, "!!", "", 0.0), (1003, "pan " * 50_000 + "vile rotten nasty awful vile", "", 0.0)]
    docs += [(1004, "pan pel", "", 0.0)] * 2
    return docs, labels


def test_learns_and_finds(spark):
    docs, labels = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string, label string, score double").repartition(3)
    model = q.train(table, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 4 != 2, 2000)
    out = {r.doc_id: r for r in q.score(table, model).collect()}
    held = [i for i in range(600) if i % 4 == 2]
    assert all((out[i].score >= 0.3) == (i % 5 == 0) for i in held)
    assert all(0 <= r.score <= 1 for r in out.values())
    assert out[1000].score == out[1001].score == out[1002].score < 0.3
    assert out[1003].segments[-1].start == 50_000 and out[1003].segments[-1].end == 50_005
    words = split_words(pa.array([docs[0][1]]), lower=True, terms=True)
    a, b = out[0].segments[0].start, out[0].segments[0].end
    assert {bytes(words.data[s:e]).decode() for s, e in zip(words.start[a:b], words.end[a:b])} & set(BAD)
    kept = q.reject(table, model)
    assert kept.columns == table.columns and kept.filter("doc_id = 1004").count() == 2
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.score < 0.3}


def test_no_labels_and_empty_tables(spark):
    table = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score < 0.01 for r in q.score(table, q.train(table, none, F.lit(True))).collect()] == [True, True]
    only = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, toxic int")
    assert [r.score > 0.99 for r in q.score(table, q.train(table, only, F.lit(True))).collect()] == [True, True]
    assert q.score(table.limit(0), q.Model()).count() == 0


def test_held_out_rows(spark, data):
    rows = q.op9_toxicity(spark, data).select("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c"))
    assert rows.filter("held_out <> (c % 4 = 2)").count() == 0
