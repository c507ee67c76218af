"""Small hand-written cases."""

import json
import random
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opslens.functions import fixed, labels
from opslens.functions.strictjson import strict_json
from opslens.operators import alerts, apply, documents as docs, flow, graph, metrics, tasks
from opslens.operators.documents import FieldRule
from opslens.sources import configs, logs


def ts(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


# ------------------------------------------------------------------ tasks


def test_deadline_order(spark):
    queue = spark.createDataFrame(
        [(1, "q", "2024-01-01 00:00:30", 1), (2, "q", "2024-01-01 00:00:10", 2), (3, "q", None, 3)], "task_id int, queue string, deadline string, seq bigint"
    )
    got = tasks.edf_order(ts(queue, "deadline"), ["queue"], F.lit("2024-01-01 00:00:20").cast("timestamp")).orderBy("rank").collect()
    assert [r.task_id for r in got] == [2, 1, 3]
    assert [r.deadline_missed for r in got] == [True, False, False]


def test_dependencies(spark):
    rows = spark.createDataFrame(
        [(1, "completed", []), (2, "pending", [1]), (3, "pending", [1, 2]), (4, "pending", [99]), (5, "pending", [])], "task_id bigint, status string, depends_on array<bigint>"
    )
    got = {r.task_id: (r.unmet, r.dependency_state) for r in tasks.dependencies_satisfied(rows).collect()}
    assert got == {1: (0, "ready"), 2: (0, "ready"), 3: (1, "blocked"), 4: (1, "blocked"), 5: (0, "ready")}


def test_preemption_rule(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = spark.createDataFrame(
        [
            ("p", 1, "running", 50, True, False, "2024-01-01 00:01:40", 1),
            ("p", 2, "running", 20, False, False, None, 2),
            ("p", 3, "pending", 80, True, True, "2024-01-01 00:01:30", 3),
            ("p", 4, "pending", 80, True, True, "2024-01-01 00:01:10", 4),
            ("p", 5, "pending", 100, True, True, "2024-01-01 01:00:00", 5),
            ("p", 6, "pending", 50, True, True, "2024-01-01 00:00:01", 6),
            ("p", 7, "pending", 100, True, False, "2024-01-01 00:00:01", 7),
        ],
        "pool string, task_id bigint, status string, priority7 int, is_preemptible boolean, is_hard_realtime boolean, deadline string, seq bigint",
    )
    got = tasks.preemption_candidates(ts(rows, "deadline"), ["pool"], now)
    assert sorted((r.task_id, r.victim_id) for r in got.collect()) == [(4, 1), (5, 1)]


def test_still_queued_after_retries(spark):
    rows = [("q", 1, i, e) for i, e in enumerate(("put", "get", "put"))] + [("q", 2, 3, "put"), ("q", 2, 4, "get"), ("q", 3, 5, "put"), ("r", 3, 6, "get"), ("q", 4, 0, "put")]
    log = spark.createDataFrame(rows, "queue_id string, task_id bigint, seq bigint, event string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert sorted((r.queue_id, r.task_id, r.seq) for r in flow.still_queued(log).collect()) == [("q", 1, 2), ("q", 3, 5), ("q", 4, 0)]
    cleared = spark.createDataFrame([("q", 2)], "queue_id string, clear_seq bigint")
    assert [r.task_id for r in flow.still_queued(log, cleared).collect()] == [3]


def test_success_half(spark):
    events = spark.createDataFrame([(50, "pending"), (50, "pending"), (50, "completed"), (50, "failed")], "priority7 int, event string")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    row = flow.scheduling_summary(events, start, F.lit("2024-01-01 00:00:10").cast("timestamp")).where("priority7 IS NULL").first()
    assert (row.submitted, row.completed, row.failed, row.success_pct, row.throughput_per_second) == (2, 1, 1, 50.0, 0.1)


def test_queue_distribution(spark):
    rows = [("q", 0, "put"), *[("q", 1, "put")] * 2, *[("q", 2, "put")] * 3, ("q", 3, "put")]
    row = flow.queue_stats(spark.createDataFrame(rows, "queue_id string, priority5 int, event string")).first()
    assert (row["size"], row.distribution) == (7, {0: 1, 1: 2, 2: 3, 3: 1})


def test_scaling_rules(spark):
    ticks = spark.createDataFrame([(11, 2, 1, 3), (0, 2, 1, 3), (0, 1, 1, 3), (16, 3, 1, 3), (4, 0, 1, 3)], "queue_size bigint, active_workers bigint, min_workers bigint, max_workers bigint")
    assert [r.change for r in flow.scaling_decision(ticks).collect()] == [1, -1, 0, 0, 1]
    assert [r.target for r in flow.scaling_decision(ticks, rule="adaptive").collect()] == [3, 1, 1, 3, 1]


# ------------------------------------------------------------------ metrics and alerts


def test_histogram_is_cumulative(spark):
    df = spark.createDataFrame([("h", v) for v in (0.5, 3.0, 7.0, 15.0)], "name string, value double")
    got = metrics.histogram_buckets(df, ["name"], [1, 5, 10]).orderBy("bound").collect()
    assert [r["count"] for r in got] == [1, 2, 3]


def test_labels(spark):
    row = spark.range(1).select(
        labels.format_labels(labels.merge_labels(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))).alias("x"),
        labels.format_labels(F.create_map().cast("map<string,string>")).alias("y"),
        *[labels.number_text(F.lit(v)).alias(f"n{i}") for i, v in enumerate((3.0, 12.5, 1.5e9, 123456789.25))],
    ).first()
    assert tuple(row) == ('{a="1",b="3"}', "", "3.0", "12.5", "1500000000.0", "123456789.25")


def test_health_limits(spark):
    df = spark.createDataFrame([("memory", 85.0), ("cpu", 75.0), ("memory", 80.0), ("cpu", 90.5)], "check string, percent double")
    got = [r.s for r in df.select(alerts.health_class().alias("s")).collect()]
    assert got == ["degraded", "degraded", "healthy", "unhealthy"]
    assert df.select(alerts.health_message().alias("m")).first().m == "Memory usage high: 85.0%"


def test_default_rules(spark):
    rules = alerts.default_rules(spark)
    samples = spark.createDataFrame(
        [("reasoning_latency_ms", 60.0, {"system": "1"}), ("reasoning_latency_ms", 60.0, {"system": "2"}), ("active_workers", 1.0, {})],
        "name string, value double, labels map<string,string>",
    )
    got = {r.rule: r.breach for r in alerts.match_alert_rules(samples, rules).collect()}
    assert got == {"HighSystem1Latency": True, "HighSystem2Latency": False, "InsufficientWorkers": True}
    assert rules.count() == 9 and len(fixed.ALERT_RULES) == 9


def test_failing_handler_does_not_stop_others(spark):
    seen = []

    def bad(_df):
        raise ValueError("no")

    errors = alerts.notify(spark.range(3), {"bad": bad, "good": lambda df: seen.append(df.count())})
    assert errors == {"bad": "no"} and seen == [3]


def test_exposition_file(spark, tmp_path):
    kinds = spark.createDataFrame([("a", "counter", "things"), ("t", "timer", "time")], "name string, type string, description string")
    current = spark.createDataFrame([("a", {"x": "1"}, 2.0)], "name string, labels map<string,string>, value double")
    metrics.write_exposition(metrics.exposition_lines(kinds, current), str(tmp_path / "out"))
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().split("\n")[:-1]]
    assert lines == ["# HELP a things", "# TYPE a counter", 'a{x="1"} 2.0', "", "# HELP t time", "# TYPE t timer", ""]


# ------------------------------------------------------------------ graph


def test_two_task_deadlock(spark):
    holds = spark.createDataFrame([("r1", 1), ("r2", 2)], "resource string, task_id bigint")
    waits = spark.createDataFrame([("r2", 1), ("r1", 2)], "resource string, task_id bigint")
    got = graph.deadlocked_tasks(graph.wait_for_edges(holds, waits)).collect()
    assert sorted((r.task_id, r.component) for r in got) == [(1, 1), (2, 1)]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (7, 1), (6, 8), (9, 10), (10, 9), (10, 1)]
    df = spark.createDataFrame(edges, "waiter bigint, holder bigint")
    got = sorted((r.task_id, r.component) for r in graph.deadlocked_tasks(df).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (9, 9), (10, 9)]


def test_text_ids(spark):
    df = spark.createDataFrame([("a-1", "b-2"), ("b-2", "a-1"), ("c", "a-1")], "waiter string, holder string")
    assert sorted((r.task_id, r.component) for r in graph.deadlocked_tasks(df).collect()) == [("a-1", "a-1"), ("b-2", "a-1")]


def test_no_deadlock(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(20)], "waiter bigint, holder bigint")
    assert graph.deadlocked_tasks(df).count() == 0


def test_transitive_priority(spark):
    t = spark.createDataFrame([(1, 20), (2, 50), (3, 90), (4, 10)], "task_id bigint, priority7 int")
    edges = spark.createDataFrame([(3, 2), (2, 1), (1, 4)], "waiter bigint, holder bigint")
    direct = {r.task_id: r.effective for r in graph.inherited_priority(t, edges).collect()}
    deep = {r.task_id: r.effective for r in graph.inherited_priority(t, edges, transitive=True).collect()}
    assert direct == {1: 50, 2: 90, 3: 90, 4: 20} and deep == {1: 90, 2: 90, 3: 90, 4: 90}


# ------------------------------------------------------------------ documents


def flat(spark, *texts, **options):
    rows = [(f"s{i}", f"f{i}", i, i, t) for i, t in enumerate(texts)]
    return docs.flatten(spark.createDataFrame(rows, "scope string, source string, priority int, loaded_seq int, doc string"), **options)


def leaf_set(df):
    return {(r.path, r.value, r.value_type) for r in df.collect()}


def test_flatten(spark):
    doc = {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}, "n": None, "l": [1, {"x": 2}], "e": {}, "s": "t", "b": True, "x": 1.5}
    got = leaf_set(flat(spark, json.dumps(doc)))
    want = {
        ("a.b.c.d.e.f", "1", "int"),
        ("n", None, "null"),
        ("l", '[1,{"x":2}]', "list"),
        ("s", "t", "string"),
        ("b", "true", "bool"),
        ("x", "1.5", "float"),
    }
    assert got == want
    assert leaf_set(flat(spark, json.dumps(doc), keep_empty=True)) == want | {("e", "{}", "dict")}


NUMBERS = '{"one":1.0,"big":1e20,"whole":123456789012345678901234567890,"small":1.50,"minus":-0.0,"k":1,"k":{"z":2},"k":3,"l":[1.0,1e20]}'
NUMBER_LEAVES = {
    ("one", "1.0", "float"),
    ("big", "1e+20", "float"),
    ("whole", "123456789012345678901234567890", "int"),
    ("small", "1.5", "float"),
    ("minus", "-0.0", "float"),
    ("k", "3", "int"),
    ("l", "[1.0,1e+20]", "list"),
}


def nested(text, levels):
    for i in range(levels, 0, -1):
        text = f'{{"p{i}":{text}}}'
    return text


@pytest.mark.parametrize("levels", [0, 1, 6, 300])
def test_values_do_not_depend_on_depth(spark, levels):
    prefix = "".join(f"p{i}." for i in range(1, levels + 1))
    want = {(prefix + p, v, k) for p, v, k in NUMBER_LEAVES}
    text = nested(NUMBERS, levels)
    assert leaf_set(flat(spark, text)) == want
    docs.register_explode_leaves(spark)
    spark.createDataFrame([(text,), (None,), ("[1]",)], "doc string").createOrReplaceTempView("deep_docs")
    assert leaf_set(spark.sql("SELECT l.* FROM deep_docs t, LATERAL explode_leaves(t.doc) l")) == want


@pytest.mark.parametrize("levels", [0, 6])
def test_leaves_as_an_array_for_tables(spark, levels):
    text = nested(NUMBERS, levels)
    docs.register_explode_leaves(spark)
    spark.createDataFrame([(1, text), (2, None), (3, "[1]"), (4, text)], "k int, doc string").createOrReplaceTempView("many_docs")
    got = spark.sql("SELECT t.k, l.* FROM many_docs t LATERAL VIEW inline(explode_leaves_array(t.doc)) l")
    want = leaf_set(flat(spark, text))
    assert [leaf_set(got.where(f"k = {k}").drop("k")) for k in (1, 2, 3, 4)] == [want, set(), set(), want]


def test_documents_of_one_file_are_dealt_to_all_cores(spark, data):
    from opslens.sources import tables

    assert spark.read.parquet(f"{data}/orders.parquet").rdd.getNumPartitions() == 1
    sizes = tables.config_doc(spark, data).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism


def test_no_object_no_rows(spark):
    odd = [None, "", "1", "[{}]", '{"a":1} x', '{"a":NaN}', '{"a":Infinity}', "{", "{}", '{"":1}', nested("1", 100_000)]
    got = flat(spark, *odd, '{"a":"\\ud800x"}').select("scope", *docs.LEAF).collect()
    assert [tuple(r) for r in got] == [("s11", "a", "?x", "string")]


def test_unflatten_restores(spark):
    doc = {"a": {"b": 1, "c": {"d": "x\"y\\z"}}, "n": None, "l": [1, "two"], "t": False}
    assert json.loads(docs.unflatten(flat(spark, json.dumps(doc))).first().doc) == doc


def merge(spark, *layers):
    rows = [("s", "f", i, i, json.dumps(t)) for i, t in enumerate(layers)]
    df = spark.createDataFrame(rows, "scope string, source string, priority int, loaded_seq int, doc string")
    out = docs.unflatten(docs.merge_by_priority(docs.flatten(df, keep_empty=True))).collect()
    return json.loads(out[0].doc) if out else {}


def python_merge(*layers):
    def deep(base, update):
        out = dict(base)
        for k, v in update.items():
            out[k] = deep(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
        return out

    result = {}
    for layer in layers:
        result = deep(result, layer)
    return result


@pytest.mark.parametrize(
    "layers",
    [
        [{"a": {"b": 1, "c": 2}}, {"a": {"c": 3}, "d": 4}],
        [{"a": {"b": 1}}, {"a": 5}],
        [{"a": {"b": 1}}, {"a": 5}, {"a": {"c": 2}}],
        [{"a": 5, "b": 1}, {"a": {}}],
        [{"a": {"b": 1}}, {"a": {}}],
        [{"a": {"b": {"c": 1}, "d": 2}}, {"a": {"b": 7}}, {"a": {"b": {"e": 3}}}],
        [{"a": [1, 2]}, {"a": [3]}, {"z": None}],
    ],
)
def test_merge(spark, layers):
    assert merge(spark, *layers) == python_merge(*layers)


def test_merge_keeps_empty_objects(spark):
    assert merge(spark, {"a": 5, "b": {"q": 1}}, {"a": {}, "b": 7}, {"b": {}}) == {"a": {}, "b": {}}


def test_random_merges(spark):
    rng = random.Random(8)

    def tree(depth):
        if depth == 0 or rng.random() < 0.4:
            return rng.choice([1, "x", None, [1], {}])
        return {rng.choice("abc-"): tree(depth - 1) for _ in range(rng.randrange(4))}

    scopes = [[{k: tree(3) for k in "ab"} for _ in range(rng.randrange(1, 6))] for _ in range(150)]
    # the order of layers is that of priority, then load
    rows = [(None if i == 0 else f"s{i}", j // 2, j % 2, json.dumps(layer)) for i, layers in enumerate(scopes) for j, layer in enumerate(layers)]
    df = spark.createDataFrame(rows, "scope string, priority int, loaded_seq int, doc string").repartition(5)
    out = docs.unflatten(docs.merge_by_priority(docs.flatten(df, keep_empty=True))).collect()
    got = {r.scope: json.loads(r.doc) for r in out}
    want = {None if i == 0 else f"s{i}": python_merge(*layers) for i, layers in enumerate(scopes)}
    assert got == {k: v for k, v in want.items() if v}


def test_defaults_below_empty_objects(spark):
    rules = [docs.FieldRule("e.x", "int", default=1), docs.FieldRule("m.x", "int", default=2), docs.FieldRule("t", "str", default="d")]
    got = leaf_set(docs.apply_defaults(flat(spark, '{"e":{},"f":{},"a":1}', keep_empty=True), rules))
    assert got == {("e.x", "1", "int"), ("f", "{}", "dict"), ("a", "1", "int"), ("t", "d", "string")}


def test_expand(spark):
    leaves = spark.createDataFrame(
        [
            ("s", "a", "${A}/${B:-b}/${C}", "string"),
            ("s", "b", "${C:?need c}", "string"),
            ("s", "c", '["${A}","x"]', "list"),
            ("s", "d", "7", "int"),
            ("s", "e", "${ A }${A:-z}", "string"),
            ("s", "f", "${LOOP}", "string"),
        ],
        "scope string, path string, value string, value_type string",
    )
    env = {"A": 'q"', "LOOP": "${A}"}
    for source in (env, spark.createDataFrame([("s", k, v) for k, v in env.items()], "scope string, name string, value string")):
        got = {r.path: (r.value, r.error) for r in docs.expand_vars(leaves, source).collect()}
        assert got["a"] == ('q"/b/${C}', None)
        assert got["b"][1] == "Environment variable C not set: need c"
        assert json.loads(got["c"][0]) == ['q"', "x"]
        assert got["d"] == ("7", None)
        assert got["e"] == ('q"q"', None)
        assert got["f"] == ("${A}", None)


def test_mask(spark):
    doc = {"password": "x", "api_key": 5, "secret_token": None, "db": {"Public_Key": True, "host": "h"}, "keys": ["a", {"token": "t", "n": {"key": [1]}}], "secret": {"name": "n"}}
    got = json.loads(docs.unflatten(docs.mask_sensitive(flat(spark, json.dumps(doc)))).first().doc)
    assert got == {
        "password": "***",
        "api_key": "***",
        "secret_token": None,
        "db": {"Public_Key": "***", "host": "h"},
        "keys": ["a", {"token": "***", "n": {"key": [1]}}],
        "secret": {"name": "n"},
    }


def messages(spark, doc, rules):
    return {r.message for r in docs.validate_fields(flat(spark, json.dumps(doc)), rules).collect()}


def test_validation(spark):
    rules = [
        FieldRule("s", "string", min_length=3),
        FieldRule("i", "int", min_value=1),
        FieldRule("f", "float", max_value=2.5),
        FieldRule("b", "bool"),
        FieldRule("u", "url"),
        FieldRule("p", "port"),
        FieldRule("e", "enum", allowed_values=("a", "b")),
        FieldRule("l", "list", item_type="int", max_length=3),
        FieldRule("o", "list", required=False, item_rules=(FieldRule("host", "string"), FieldRule("n", "int", required=False))),
        FieldRule("d", "dict"),
        FieldRule("d.x", "int"),
        FieldRule("opt", "int", required=False),
        FieldRule("q.r", "int"),
    ]
    good = {"s": "abc", "i": 1, "f": 2, "b": False, "u": "https://a.b/c", "p": 65535, "e": "a", "l": [1, 2], "d": {"x": 1}, "o": [{"host": "h"}]}
    assert messages(spark, good, rules) == set()
    bad = {"s": "ab", "i": True, "f": 2.6, "b": 1, "u": "ftp://x", "p": 0, "e": "c", "l": [1, "x"], "d": {"x": None}, "opt": "1", "o": [{"host": "h"}, {"n": "y"}]}
    assert messages(spark, bad, rules) == {
        "s: String length 2 is less than minimum 3",
        "i: Expected integer, got bool",
        "f: Value 2.6 exceeds maximum 2.5",
        "b: Expected boolean, got int",
        "u: Invalid URL format",
        "p: Port number must be between 1 and 65535",
        "e: Value 'c' not in allowed values: ['a', 'b']",
        "l.1: Expected integer, got str",
        "d.x: Required field is missing",
        "opt: Expected integer, got str",
        "o[1].host: Required field is missing",
        "o[1].n: Expected integer, got str",
    }


def test_missing_and_unknown(spark):
    leaves = flat(spark, json.dumps({"a": {"b": 1}, "n": None, "z": {"y": 1}}))
    assert {r.path for r in docs.missing_required(leaves, ["a", "a.b", "n", "q.r"]).collect()} == {"n", "q.r"}
    rules = [FieldRule("a", "dict"), FieldRule("a.c", "int")]
    assert {r.path for r in docs.unknown_fields(leaves, rules).collect()} == {"a.b", "n", "z"}


def test_get_path_null_and_absent(spark):
    df = spark.createDataFrame([('{"a":{"b":null,"c":"x"},"k":1}',)], "doc string")
    out = docs.get_path(docs.get_path(docs.get_path(df, "a.b", "d", out="x"), "a.q", "d", out="y"), "k.z", out="z")
    out = docs.get_section(docs.get_section(out, "a", out="s"), "k", out="t").first()
    assert (out.x, out.y, out.z, json.loads(out.s), out.t) == (None, "d", None, {"b": None, "c": "x"}, "{}")


def test_strict_json(spark):
    texts = ['{"a":1}', '{"a":1}}', "1,2", "80 abc", "", " 7 ", "null", "x", "[1]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.o for r in df.select(strict_json("t").isNotNull().alias("o")).collect()] == [True, False, False, False, False, True, True, False, True]


def test_environment(spark):
    env = spark.createDataFrame(
        [("s", "APP_A__B", "1"), ("s", "APP_C", "80 abc"), ("s", "APP_D", '{"x":1}'), ("s", "OTHER", "1"), ("s", "APP_T", "true")], "scope string, name string, value string"
    )
    assert leaf_set(configs.env_to_leaves(env, "app")) == {("a.b", "1", "int"), ("c", "80 abc", "string"), ("d", '{"x":1}', "dict"), ("t", "true", "bool")}


def test_config_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"db": {"password": "p", "port": 1}}')
    (tmp_path / "in" / "b.json").write_text("{broken")
    (tmp_path / "in" / "c.yml").write_text("")
    (tmp_path / "in" / "plain").write_text('{"x": 1}')
    read = configs.read_config_docs(spark, str(tmp_path / "in"))
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.doc == "{}", r.error is not None) for r in read.collect()}
    assert got == {"a.json": ("json", False, False), "b.json": ("json", True, True), "plain": ("json", False, False)} | ({"c.yml": ("yaml", True, False)} if "c.yml" in got else {})
    leaves = docs.flatten(read.select(F.regexp_extract("path", "([^/]+)$", 1).alias("scope"), "doc"))
    configs.write_config(leaves, str(tmp_path / "out"), mask=True)
    text = next((tmp_path / "out" / "scope=a.json").glob("part-*")).read_text()
    assert json.loads(text) == {"db": {"password": "***", "port": 1}}


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_config_formats(spark, tmp_path, fmt):
    """Keys with quotes and marks, numbers as written, null keys; two key columns."""
    rows = [('a",\\"doc":{', 1, '{"x":1.50,"y":{"z":[1,"}"]}}'), (None, 2, '{"e":{},"n":null}'), ("", None, '{"t":"\\"doc\\":"}')]
    read = spark.createDataFrame(rows, "scope string, part int, doc string")
    leaves = docs.flatten(read)
    configs.write_config(leaves, str(tmp_path / "out"), fmt=fmt, keys=("scope", "part"))
    back = configs.read_written_config(spark, str(tmp_path / "out"), fmt, "scope string, part int")
    want = {(r.scope, r.part, r.path, r.value, r.value_type) for r in leaves.collect()}
    assert {(r.scope, r.part, r.path, r.value, r.value_type) for r in docs.flatten(back).collect()} == want and len(want) == 4
    with pytest.raises(ValueError):
        configs.write_config(leaves, str(tmp_path / "out"), fmt="ini")


# ------------------------------------------------------------------ logs and codecs


def test_log_lines(spark, tmp_path):
    line = {"timestamp": "2024-01-01T00:00:00.5", "level": "INFO", "message": "m", "user": "u", "exception": {"type": "E", "message": "x", "traceback": ["a"]}, "context": {"operation": "o"}}
    (tmp_path / "in.log").write_text(json.dumps(line) + "\nnot json\n")
    got = logs.read_structured_logs(spark, str(tmp_path / "in.log")).collect()
    assert got[0].extra == {"user": "u"} and got[0].context == {"operation": "o"} and got[0].exception.traceback == ["a"]
    assert got[1]._corrupt_record == "not json"
    good = logs.read_structured_logs(spark, str(tmp_path / "in.log")).where("_corrupt_record IS NULL")
    logs.write_structured_logs(good, str(tmp_path / "out"))
    text = next((tmp_path / "out" / "date=2024-01-01").glob("part-*")).read_text()
    assert json.loads(text) == line


def test_log_values_keep_their_types(spark):
    extras = {"ratio": 12.5, "code": "12.5", "ok": True, "yes": "true", "o": {"x": {"y": "1"}}, "l": [1, "1", None], "none": None, "big": 12345678901234567890, "text": '{"c":1}'}
    lines = [{"timestamp": "2024-01-01", "message": "m", "context": {"n": 1, "o": {"a": [1, "1", True]}, "t": "1"}, **extras}, {"a": 1}, {"message": "plain"}]
    records = logs.parse_structured_logs(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string"))
    assert [json.loads(r.value) for r in logs.format_structured_logs(records).collect()] == lines
    # records made elsewhere have text alone
    text = logs.format_structured_logs(records.drop("extra_values", "context_values")).collect()
    assert json.loads(text[0].value)["ratio"] == "12.5"


def test_failing_bodies(spark):
    t = spark.createDataFrame([(1, "e", 1.0), (2, "f", 2.0), (3, "f", 0.0), (4, "x", 1.0)], "task_id bigint, task_type string, v double")

    def body(part):
        if (part["v"] == 0).any():
            raise ValueError("bad value")
        return 1 / part["v"]

    got = {r.task_id: (r.success, r.result, r.error) for r in apply.apply_by_type(t, {"e": F.col("v") * 3}, {"f": body}).collect()}
    assert got == {1: (True, 3.0, None), 2: (True, 0.5, None), 3: (False, None, "bad value"), 4: (False, None, "No worker pool for task type: x")}


def test_codecs(spark):
    df = spark.createDataFrame([("aGk=",), ("%%%",)], "data string")
    assert [(r.value, r.error) for r in apply.decode_messages(df, "base64").collect()] == [("hi", None), (None, "Cannot decode Base64 data")]
    df = spark.createDataFrame([("<MSG>x</MSG>",), ("x",)], "data string")
    assert [(r.value, r.error) for r in apply.decode_messages(df, "framed").collect()] == [("x", None), (None, "Invalid message format")]
    good, dead = apply.split_decoded(apply.decode_messages(df, "framed"))
    assert (good.count(), dead.count()) == (1, 1)


def test_quotes_in_paths(spark):
    df = spark.createDataFrame([('{"it\'s":{"a\\\\b":1}}',)], "doc string")
    assert docs.get_path(df, "it's.a\\b").first().value == "1"
    assert docs.get_path(df, "it's.x", default="o'\\n").first().value == "o'\\n"
    assert docs.get_section(df, "it's").first().section == '{"a\\\\b":1}'


def test_bad_rows_of_a_batch_stand_alone(spark):
    calls = []

    def body(part):
        calls.append(len(part))
        if (part["v"] < 0).any():
            raise ValueError(f"bad {part['v'].min()}")
        return part["v"] * 2

    part = pd.DataFrame({"task_id": [f"t{i}" for i in range(1000)], "v": [-1 if i in (3, 700) else i for i in range(1000)]})
    got = apply._run_batch(part, body)
    assert list(got.task_id) == list(part.task_id) and list(got[~got.success].task_id) == ["t3", "t700"]
    assert got.result[999] == 1998 and len(calls) < 60


def test_retry_runs_only_what_failed(spark, tmp_path):
    """Bodies that fail at random by a seed; every run of one leaves a line."""
    seen = str(tmp_path / "runs")
    fails = lambda task, attempt: zlib.crc32(f"{task}/{attempt}".encode()) % 100 < 40

    def body(part):
        task, attempt = part["task_id"].iloc[0], part["attempt"].iloc[0]
        if len(part) > 1:
            raise ValueError("one by one")
        with open(seen, "a") as f:
            f.write(f"{task}/{attempt}\n")
        if fails(task, attempt):
            raise ValueError(f"failed {attempt}")
        return part["v"] + part["attempt"]

    ids = [f"u{i}" for i in range(60)]
    df = spark.createDataFrame([(t, "f", float(i)) for i, t in enumerate(ids)] + [("e1", "e", 5.0), ("n1", None, 1.0)], "task_id string, task_type string, v double")
    expression = F.when(F.col("attempt") >= 3, F.col("v"))
    got = sorted(tuple(r) for r in apply.run_with_retry(df, {"e": expression}, {"f": body}, 2).collect())
    want = [("e1", n, n == 3, 5.0 if n == 3 else None, "completed" if n == 3 else "retried", None if n == 3 else "no result") for n in (1, 2, 3)]
    want += [("n1", n, False, None, "failed" if n == 3 else "retried", "No worker pool for task type: none") for n in (1, 2, 3)]
    for i, t in enumerate(ids):
        for n in (1, 2, 3):
            bad = fails(t, n)
            want.append((t, n, not bad, None if bad else float(i + n), ("failed" if n == 3 else "retried") if bad else "completed", f"failed {n}" if bad else None))
            if not bad:
                break
    assert got == sorted(want)
    with open(seen) as f:
        assert sorted(f.read().split()) == sorted(f"{r[0]}/{r[1]}" for r in want if r[0][0] == "u")
