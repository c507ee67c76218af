"""Plans that must hold at scale."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from opslens.operators import alerts, flow, graph, logs, metrics, stats, tasks
from opslens.plans import quantiles
from opslens.sources import logs as log_source, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, data):
    text = plan(stats.samples_since(tables.metric(spark, data), F.lit("2024-01-20").cast("timestamp")).select("name", "value"))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text
    text = plan(tables.health(spark, data))
    assert "PushedFilters: [In(event_type" in text


def test_top_k_of_one_queue(spark, data):
    assert "TakeOrderedAndProject" in plan(tasks.next_k(tables.task(spark, data), [], [F.col("seq")], 10))


def test_bounded_history_is_pruned_before_the_shuffle(spark, data):
    assert plan(stats.keep_last(tables.metric(spark, data), ["name"], 10_000)).count("WindowGroupLimit") >= 2


def test_rules_are_broadcast_by_size(spark, data):
    text = plan(alerts.match_alert_rules(tables.metric(spark, data), tables.alert_rule(spark)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_histogram_does_not_multiply_rows(spark, data):
    text = plan(metrics.histogram_buckets(tables.metric(spark, data), ["name"]))
    assert text.index("Generate inline") < text.index("HashAggregate") and text.count("Exchange") == 1


def test_no_pairs(spark, data):
    claims = tables.resource_claim(spark, data)
    frames = [
        graph.wait_for_edges(tables.resource_hold(claims), tables.resource_wait(claims)),
        flow.active_over_time(tables.result(spark, data), 100),
        tasks.preemption_candidates(tables.task(spark, data), ["pool"], F.lit("1998-01-01").cast("timestamp")),
    ]
    for df in frames:
        text = plan(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_order_statistics_are_lazy_and_bounded(spark, monkeypatch):
    """No job while the result is defined, no window over more than 2,048 rows, whatever the values."""
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([rng.randrange(10**6) / 7, 1.0 + rng.random() * 2e-13, rng.gauss(0, 10.0 ** rng.randrange(-9, 9))])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "k string, value double")
    group = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "definition")
    summary = stats.metric_summary(df, ["k"])
    assert list(group.getJobIdsForGroup("lazy")) == []
    got = {r.k: r for r in summary.collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for k in (None, "a", "b"):
        values = [v for n, v in rows if n == k]
        assert got[k]["count"] == len(values) and got[k]["median"] == statistics.median(values)
        assert got[k].p95 == pytest.approx(statistics.quantiles(values, n=20)[18], rel=1e-12)
    # a filter that lets nearly every row through changes nothing
    monkeypatch.setattr(quantiles, "FILTER_WORDS", 1)
    assert {r.k: r for r in stats.metric_summary(df, ["k"]).collect()} == got
    number = df.select("k", quantiles.value_order("value").alias("o"))
    for dropped in (53, 42, 31, 20, 9, 0):
        inner = number.select("k", F.shiftright("o", dropped).alias("p")).distinct()
        outer = [F.shiftright("p", 11 if dropped else 9)] if dropped < 53 else []
        assert inner.groupBy("k", *outer).count().agg(F.max("count")).first()[0] <= 2048


def test_log_stream_matches_batch(spark, data, tmp_path):
    tables.log_line(spark, data).repartition(3).write.text(str(tmp_path / "logs"))
    stream = log_source.stream_structured_logs(spark, str(tmp_path / "logs"))
    from opslens.streaming.jobs import run_available

    got = run_available(logs.performance_records(stream).drop("ts"), "logs")
    want = logs.performance_records(log_source.read_structured_logs(spark, str(tmp_path / "logs"))).drop("ts")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0
