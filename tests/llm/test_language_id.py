import random

from pyspark.sql import functions as F

from opslens.llm import language_id as q

SOUNDS = {"aa": ["lor", "mip", "dan", "o"], "bb": ["zch", "urg", "tst", "ä"], "cc": ["ñi", "que", "ao", "el"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang := rng.choice(sorted(SOUNDS)), rng.randrange(3, 200)), lang, "x") for i in range(400)]
    rows += [(500, None, "aa", ""), (501, "", "bb", ""), (502, "12 !? \n", "aa", ""), (503, "ääää", None, ""), (504, text(rng, "cc", 60_000), None, "")]
    rows += [(505, "lor mip dan", None, "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    out = q.identify(docs, q.train(docs, F.col("doc_id") % 3 != 1, 300, 40)).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert all(got[i].lang_pred == lang for i, _, lang, _ in rows[:400])
    assert [(got[i].lang_pred, got[i].score) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert got[503].lang_pred != "und" and got[504].lang_pred == "cc"


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "def", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in q.identify(docs, q.train(docs, F.lit(True))).collect()] == ["und", "und"]
    assert q.identify(docs.limit(0), q.train(docs, F.lit(True))).count() == 0


def test_kernel_counts_common_ngrams():
    import numpy as np

    data = np.frombuffer(b"abcabcxyz", np.uint8)
    x = q.presence(data, np.array([0, 3, 6, 9, 9]))
    k = q.kernel(x, x)
    assert abs(k[0, 1] - 1) < 1e-6 and k[0, 2] == 0 and k[3].sum() == 0
