import random

from pyspark.sql import functions as F

from opslens.llm import ngram_join, sampling as q


def test_first_by_hash(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3000), rng.randrange(3)) for _ in range(5000)]
    table = spark.createDataFrame(rows, "a long, b long").repartition(5)
    key = F.xxhash64("a")
    for limit in (0, 1, 100, 4999, 5000, 9000):
        out = [tuple(r) for r in q.first_by_hash(table, key, limit, "a", "b").collect()]
        assert out == [tuple(r) for r in table.orderBy(key, "a", "b").limit(limit).collect()]
    assert q.first_by_hash(table.limit(0), key, 5, "a").count() == 0


def test_frequent_shingles_are_the_first(spark):
    rng = random.Random(2)
    lines = [" ".join(rng.choice("abcdefg") for _ in range(8)) for _ in range(200)]
    docs = spark.createDataFrame([(" ".join(rng.sample(lines, 3)),) for _ in range(150)], "text string").repartition(1)
    everything = ngram_join.frequency_order(docs, 5, 1 << 20)
    n = len(everything.shingles)
    by_rank = dict(zip(everything.rank.tolist(), everything.shingles.tolist()))
    for size in (1, 10, n // 2, n - 1, n):
        some = ngram_join.frequency_order(docs, 5, size)
        assert dict(zip((some.rank + n - size).tolist(), some.shingles.tolist())) == {r: s for r, s in by_rank.items() if r > n - size}
