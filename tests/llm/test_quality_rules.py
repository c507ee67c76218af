from collections import Counter

from pyspark.sql import functions as F

from opslens.llm import quality_rules as q

SCHEMA = "doc_id long, text string, failed string"
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "a b c d e f a b c d e g",
    "x " * 30,
    "one two three four five six seven eight nine ten\n\n \none two three four five six seven eight nine ten",
    "café # * $ % & | < > !! \U0001f600 eleven words are here now",
    "w x y z " * 3,
    "word" * 5000,
    " ".join(f"t{i}" for i in range(20000)),
]


def by_hand(text):
    text = text or ""
    for c in "\t\n\x0b\x0c\r":
        blank = text.replace(c, " ") if c == "\t" else blank.replace(c, " ")
    words = [w for w in blank.split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measurements(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS + TEXTS[3:4])]
    out = q.ledger(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out}
    assert got == {i: by_hand(t) for i, t, _ in rows}
    assert len(out) == len(rows)


def test_policy_and_ablation(spark):
    docs = spark.createDataFrame([(i, t, "") for i, t in enumerate(TEXTS)], SCHEMA)
    rows = q.ledger(docs)
    base = {r.doc_id for r in q.apply_policy(rows, q.BASE_POLICY).filter("NOT kept").collect()}
    assert base == {i for i, t in enumerate(TEXTS) if (m := by_hand(t))[0] < 10 or 100 * m[4] > 20 * m[0]}
    out = {r.rule: (r.n_failed, r.n_only) for r in q.ablation(rows, q.BASE_POLICY).collect()}
    failed = [r.failed & 3 for r in rows.collect()]
    assert out == {"few_words": (sum(f & 1 for f in failed), failed.count(1)), "repeated_windows": (sum(f >> 1 for f in failed), failed.count(2))}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert q.ledger(empty).count() == 0
    assert {r.n_docs for r in q.ablation(q.ledger(empty)).collect()} == {0}


def test_no_python_in_plan(spark, data):
    df = q.op8_quality_rules(spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rule_order_is_the_bit_order(spark):
    one = q.with_failures(spark.range(1).selectExpr(*[f"0L AS {c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations")]))
    assert one.select(F.col("failed")).first()[0] == 1
