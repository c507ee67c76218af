import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.llm import hard_negatives as q

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, is_anchor, scale=1.0, positives=q.POSITIVES, negatives=q.NEGATIVES, low=q.LOW, high=q.HIGH):
    def good(r):
        return all(x is not None for x in r) and all(x is not None and math.isfinite(x) for x in r[2])

    rows = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in filter(good, rows)]
    out = []
    for k, (i, label, v) in enumerate(rows):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, same == label) for o, (j, same, w) in enumerate(rows) if o != k)
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            fit = [x for x in scored if not x[2] and -low * s <= -100 * x[0] <= -high * s][:negatives]
            out += [(i, j, rank, other, -s, -t) for rank, (t, other, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(df, **options):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in q.mine(df, F.col("vec_id") % 10 == 0, **options).select(names).collect())


@pytest.mark.parametrize("top", [1, 3, 150, 40_000, 2**31 - 1, 2**40])
def test_products_are_exact(top):
    rng = np.random.default_rng(top)
    for n, m, d in [(1, 1, 1), (7, 3, 5), (200, 20, 64), (3, 2, 0), (0, 2, 4)]:
        a, b = rng.integers(-top, top + 1, (n, d)), rng.integers(-top, top + 1, (m, d))
        want = b.astype(object) @ a.astype(object).T if d else np.zeros((m, n), object)
        assert (q.products(a, b) == want).all()
    same = np.full((5, 4), -top)
    assert (q.products(same, same) == 4 * top * top).all()


@pytest.mark.parametrize("blocks", [(4096, 1024), (16, 3)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(q, "ROWS", blocks[0])
    monkeypatch.setattr(q, "ANCHORS", blocks[1])
    monkeypatch.setattr(q, "AT_ONCE", 2)
    rng = random.Random(4)
    rows = [(i, rng.randrange(3), [rng.gauss(0.2, 1) for _ in range(6)]) for i in range(150)]
    # ties, zero vectors, shorter and empty ones
    rows += [(1000 + i, i % 3, [1.0, 0.5]) for i in range(20)] + [(2000, 0, [0.0] * 6), (2010, 1, []), (2011, 1, [])]
    rows += [(3000, None, [1.0]), (3010, 1, None), (3020, 1, [1.0, None]), (3030, 1, [float("nan")]), (3040, 1, [float("inf")]), (None, 1, [1.0])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"no": F.lit("x"), "score": F.lit(1.5), "dims": F.lit(None)}).repartition(5)
    assert mined(df, scale=256.0) == brute(rows, lambda i: i % 10 == 0, 256.0)
    assert mined(df, scale=4.0, positives=2, negatives=3, low=-50, high=150) == brute(rows, lambda i: i % 10 == 0, 4.0, 2, 3, -50, 150)


def test_wide_components(spark):
    rng = random.Random(6)
    rows = [(i, i % 2, [float(rng.randrange(-1_500_000_000, 1_500_000_000)) for _ in range(3)]) for i in range(60)]
    rows[1] = (1, 1, [1.5e9] * 3)
    assert q.fields_of(*[np.array([r[2] for r in rows], np.int64)] * 2) > 64
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows, lambda i: i % 10 == 0)
    # far beyond 64 bits: scores end at the limits of a long
    far = [(0, 1, [1e300]), (1, 1, [1e300]), (2, 2, [5e299]), (3, 2, [1.0])]
    got = q.mine(spark.createDataFrame(far, SCHEMA), F.col("vec_id") == 0, scale=1e20)
    assert {r.positive_score for r in got.collect()} <= {2**63 - 1}


def test_repeated_ids_and_text_ids(spark):
    rows = [(0, 1, [2.0, 1.0]), (0, 1, [2.0, 1.0]), (0, 1, [2.0, 1.0]), (5, 2, [1.0, 0.0]), (5, 2, [1.0, 0.0]), (6, 2, [1.0, 1.0])]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows, lambda i: i == 0)
    text = spark.createDataFrame([(f"v{i}", lab, v) for i, lab, v in rows], "vec_id string, label string, embedding array<float>")
    got = q.mine(text, F.col("vec_id") == "v0").select("anchor_id", "positive_id", "rank", "negative_id").collect()
    assert sorted(tuple(r) for r in got) == [(f"v{a}", f"v{p}", r, f"v{n}") for a, p, r, n, _, _ in brute(rows, lambda i: i == 0)]


def test_empty(spark):
    df = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0])], SCHEMA)
    assert q.mine(df.limit(0), F.lit(True)).count() == 0
    assert q.mine(df, F.lit(False)).count() == 0
    assert q.mine(df, F.col("vec_id") == 0).count() == 0
