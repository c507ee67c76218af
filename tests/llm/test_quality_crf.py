import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from opslens.llm import quality_crf as q


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 2, 6, 1]
    first = np.append(0, np.cumsum(sizes))
    emission, model = rng.normal(size=first[-1]), q.Model(links=rng.normal(size=(2, 2)))
    p, pairs = model.marginals(emission, first)
    true, true_pairs = np.zeros(first[-1]), np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        total, mass, joint = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(emission[a + i] * v for i, v in enumerate(labels)) + sum(model.links[x, y] for x, y in zip(labels, labels[1:])))
            total += w
            mass += w * np.array(labels)
            for x, y in zip(labels, labels[1:]):
                joint[x, y] += w
        true[a:b] = mass / total
        true_pairs += joint / total
    assert np.allclose(p, true) and np.allclose(pairs, true_pairs)


def test_lines():
    lines = q.lines_of(pa.array(["a b\n\n a b\nA! a a\n", None, "", " \n", "x"]))
    assert np.diff(lines.first).tolist() == [3, 1, 1, 1, 1]
    assert lines.length.tolist() == [3, 3, 6, 1, 1, 1, 1]
    assert lines.measures[:3, 9].tolist() == [0, 1, 0]
    assert np.allclose(lines.measures[2, [2, 7, 8]], [1 / 6, 1 / 3, 2 / 3])
    assert not lines.measures[3:6].any()


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for i in range(500):
        good = i % 4 != 0
        lines = []
        for _ in range(rng.randrange(1, 20)):
            words = [word() for _ in range(rng.randrange(3, 25))]
            if not good and rng.random() < 0.7:
                words = rng.choice([[w + "###" for w in words], [words[0]] * len(words), [w.upper() + "!!" for w in words]])
            lines.append(" ".join(words) + ".")
        docs.append((i, "\n".join(lines), "x", 1))
        labels.append((i, int(good)))
    docs += [(900, None, "", 0), (901, "", "", 0), (902, " \n\t", "", 0), (903, "word " * 100_000, "", 0), (904, "a\n" * 20_000, "", 0), (905, "b", "", 0), (905, "b", "", 0)]
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    table = spark.createDataFrame(docs, "doc_id long, text string, score string, label int").repartition(3)
    model = q.train(table, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("doc_id") % 5 != 0, 300)
    out = q.score(table, model).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    right = [(got[i].score >= 0.3) == (i % 4 != 0) for i in range(0, 500, 5)]
    assert sum(right) >= 95
    assert got[900].score == got[901].score == got[902].score and got[904].n_lines == 20_000


def test_one_kind_of_label(spark):
    table = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows, check in (([], lambda s: s < 0.01), ([(1, 1)], lambda s: s > 0.99), ([(1, None)], lambda s: s < 0.01)):
        model = q.train(table, spark.createDataFrame(rows, "doc_id long, quality int"), F.lit(True))
        assert all(check(r.score) for r in q.score(table, model).collect())
    assert q.score(table.limit(0), q.Model()).count() == 0
