import math
import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from opslens.operators import stats
from opslens.plans.quantiles import value_order


def samples(spark, values, name="m"):
    return spark.createDataFrame([(name, float(v)) for v in values], "name string, value double")


def test_summary_of_ten(spark):
    row = stats.metric_summary(samples(spark, range(10))).first()
    assert (row["count"], row["sum"], row["min"], row["max"], row["mean"], row["median"]) == (10, 45.0, 0.0, 9.0, 4.5, 4.5)


@pytest.mark.parametrize("values", [[7.5], [1, 2], [3, 3, 3, 3], [0.0, -0.0, 1e-300, -1e150, 1e150], list(range(100))])
def test_exclusive_quantiles(spark, values):
    row = stats.metric_summary(samples(spark, values)).first()
    if len(values) == 1:
        assert row.p95 == row.p99 == values[0] and row.stddev == 0.0
        return
    assert row.p95 == pytest.approx(statistics.quantiles(values, n=20)[18])
    assert row.p99 == pytest.approx(statistics.quantiles(values, n=100)[98])
    assert row["median"] == statistics.median(values)
    assert row.stddev == pytest.approx(statistics.stdev(values))


def test_quantile_may_exceed_maximum(spark):
    assert stats.metric_summary(samples(spark, [1, 2])).first().p99 == pytest.approx(2.97)


def test_empty_gives_no_row(spark):
    assert stats.metric_summary(samples(spark, [])).count() == 0


def test_random_groups_with_one_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.choice([rng.gauss(0, 1e3), rng.random() * 1e-9, 5.0])) for _ in range(4000)]
    got = {r["name"]: r for r in stats.metric_summary(spark.createDataFrame(rows, "name string, value double")).collect()}
    for name in {r[0] for r in rows}:
        values = [v for n, v in rows if n == name]
        assert got[name]["count"] == len(values)
        assert got[name].p95 == pytest.approx(statistics.quantiles(values, n=20)[18], rel=1e-9, abs=1e-12)
        assert got[name].p99 == pytest.approx(statistics.quantiles(values, n=100)[98], rel=1e-9, abs=1e-12)
        assert got[name]["median"] == pytest.approx(statistics.median(values), rel=1e-9, abs=1e-12)
        assert got[name].stddev == pytest.approx(statistics.stdev(values), rel=1e-9)


def test_numbers_keep_the_order_of_values(spark):
    rng = random.Random(2)
    values = [rng.uniform(-1, 1) * 10 ** rng.randrange(-320, 300) for _ in range(3000)] + [s * 2.0**e for e in range(-1074, 1024) for s in (1, -1)]
    values += [0.0, -0.0, float("inf"), float("-inf"), 1.7976931348623157e308, 5e-324, 2.2250738585072011e-308]
    near = values + [math.nextafter(v, math.inf) for v in values] + [math.nextafter(v, -math.inf) for v in values]
    rows = spark.createDataFrame([(float(v),) for v in near + [math.nan]], "v double").withColumn("o", value_order("v")).collect()
    for r in rows:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.o == (2047 * 2**52 + 1 if math.isnan(r.v) else -bits if r.v < 0 else bits), r.v

def test_nearest_rank_of_hundred(spark):
    rows = [(i, "t", 100, i, f"1970-01-01 00:00:{i // 1000:02d}.{i % 1000:03d}") for i in range(100)]
    df = spark.createDataFrame(rows, "task_id bigint, name string, priority7 int, seq bigint, at string")
    df = df.select(
        "task_id",
        "name",
        "priority7",
        "seq",
        F.lit("1970-01-01").cast("timestamp").alias("created_at"),
        F.col("at").cast("timestamp").alias("scheduled_at"),
        F.lit(None).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
    )
    rows = stats.latency_stats(df).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.kind, row["count"], row.p50, row.p95, row.p99, row.min, row.max) == ("scheduling", 100, 50.0, 95.0, 99.0, 0.0, 99.0)


def test_tick_averages(spark):
    ticks = spark.createDataFrame(
        [("q", "2024-01-01 00:00:00", 5, 2, 4), ("q", "2024-01-01 00:01:00", 10, 3, 4), ("q", "2024-01-01 00:02:00", 7, 0, 0)],
        "k string, ts string, queue_size bigint, active_workers bigint, total_workers bigint",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    row = stats.gauge_averages(ticks.limit(2), ["k"]).first()
    assert row.utilization_pct == pytest.approx(62.5)
    assert stats.gauge_averages(ticks, ["k"]).first().mean_queue_size == pytest.approx(22 / 3)


def test_history_keeps_the_latest(spark):
    df = spark.range(5000).select(F.lit("a").alias("name"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"))
    kept = stats.keep_last(df, ["name"], 10)
    assert sorted(r.seq for r in kept.collect()) == list(range(4990, 5000))


def test_null_key_with_dense_values(spark):
    rows = [(None if i % 2 else "a", 1 + i * 1e-9) for i in range(400)]
    out = {r.k: r for r in stats.metric_summary(spark.createDataFrame(rows, "k string, value double"), ["k"]).collect()}
    for key in (None, "a"):
        own = [v for k, v in rows if k == key]
        assert out[key]["count"] == len(own) and abs(out[key]["median"] - statistics.median(own)) < 1e-15
