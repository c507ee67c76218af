import random
import re

import corpus_pipeline as p
from test_ngram_join import by_hand as components_by_hand
from test_pii import by_hand as base_by_hand

from opslens.llm import toxicity
from opslens.llm.sampling import id_remainder

TERM = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def grams(text, n=5):
    words = TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_every_stage(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    stages = dict(p.STAGES)

    kept = stages["toxicity"](spark, docs, data)
    assert kept.columns == columns
    model = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"), id_remainder(4) != 2)
    fine = {r.doc_id for r in toxicity.score(docs, model).filter("score < 0.3").collect()}
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == fine

    unique = stages["near_duplicates"](spark, kept, data)
    assert unique.columns == columns
    found = components_by_hand([(i, r.text) for i, r in rows.items()])
    left = {r.doc_id: r for r in unique.collect()}
    assert set(left) == {i for i, (_, component) in found.items() if component == i}

    clean = stages["decontamination"](spark, unique, data)
    assert clean.columns == columns
    items = [g for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if len(g := grams(r.text)) > 3]
    now = {r.doc_id: r for r in clean.collect()}
    for i, r in left.items():
        share = max((len(g & grams(r.text)) / len(g) for g in items), default=0)
        assert (i in now) or share > 0.5
        assert (i not in now) or share < 0.9

    redacted = stages["personal_data"](spark, clean, data)
    assert redacted.columns == columns
    after = {r.doc_id: r for r in redacted.collect()}
    assert set(after) == set(now)
    for i, r in after.items():
        assert not base_by_hand(r.text) and r.n_chars == len(r.text)
        assert r.text == now[i].text or base_by_hand(now[i].text)

    pieces = stages["packing"](spark, redacted, data).collect()
    assert {r.doc_id for r in pieces} == set(after)
    ends = sorted((r.sequence_id * 4096 + r.offset, r.length) for r in pieces)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def test_run_gives_the_last_stage(spark, data):
    out = p.run(spark, data)
    assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_edge_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "mail a@b.co now", "en", "s", 15), (4, "mail a@b.co now", "en", "s", 15), (5, "x " * 50_000, "en", "s", 100_000)]
    for name, table in {
        "documents": spark.createDataFrame(rows, schema),
        "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([], "item_id long, text string"),
    }.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    out = {r.doc_id for r in p.run(spark, str(tmp_path)).collect()}
    assert out == {1, 2, 3, 5}


def test_repeated_rows_of_one_id(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "g h i j k l", 3), (2, "m n o p q r", 4), (3, "", 5), (3, "", 6), (4, None, 7), (4, None, 8), (5, "a b c d e f", 9), (None, "s t u v w x", 10), (None, "s t u v w x", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, count long").repartition(3)
    out = p.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    kept = [r["count"] for r in out.collect()]
    assert len(kept) == len(set(kept)) and set(kept) - {1, 2} == {3, 4, 5, 6, 7, 8, 10, 11} and len({1, 2} & set(kept)) == 1


def _shuffled_bytes(node):
    """Bytes that the exchanges of a finished plan were given."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _shuffled_bytes(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return _shuffled_bytes(node.plan())
    own = node.metrics().apply("dataSize").value() if name == "ShuffleExchangeExec" else 0
    children = node.children()
    return own + sum(_shuffled_bytes(children.apply(i)) for i in range(children.size()))


def test_texts_stay_out_of_joins(spark):
    """Of all texts only those whose fate the filters leave open are shuffled in the stage of near duplicates."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(1000))) for i in range(100)]
    rows += [(100 + i, t) for i, t in rows[:5]] + [rows[50]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = p.drop_near_duplicates(spark, docs, "")
        assert sorted(map(tuple, out.collect())) == sorted(rows[:100])
        assert _shuffled_bytes(out._jdf.queryExecution().executedPlan()) < 100_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
