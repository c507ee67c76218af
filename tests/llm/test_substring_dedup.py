import hashlib
import json
import os
import random
import re
import subprocess
import sys

from opslens.llm import substring_dedup as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows, window):
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out[i] = (len(w), sum(gone), b" ".join(x.encode() for x, g in zip(w, gone) if not g))
    return out


def run(spark, rows, window=q.WINDOW, anchor=q.ANCHOR):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, source string, lo int").repartition(3)
    out = q.remove_spans(docs, q.repeated_spans(docs, window, anchor), window)
    return {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in out.collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(200)] + ["é", "ß x"]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = some(70)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "a " * 300), (4, "a " * 180), (5, "a  b\n" * 60), (6, "a b " * 45)]
    base = some(400)
    for i in range(7, 60):
        text = some(rng.randrange(120))
        if i % 3 == 0:
            text += shared + some(rng.randrange(40))
        if i % 4 == 0:
            edited = list(base[rng.randrange(50) :])
            for _ in range(rng.randrange(6)):
                edited[rng.randrange(len(edited))] = rng.choice(vocab)
            text += edited
        rows.append((i, rng.choice([" ", "\n", "  ", "\x0b"]).join(text)))
    rows += [(100, rows[-1][1]), (101, rows[-1][1])]
    assert run(spark, rows) == by_hand(rows, q.WINDOW)


def test_small_windows(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for i in range(80)]
    assert run(spark, rows, 6, 3) == by_hand(rows, 6)


def test_very_long_text(spark):
    long = " ".join(f"t{i}" for i in range(200_000))
    rows = [(1, long), (2, "x " + long), (3, "t5 " * 10)]
    got = run(spark, rows)
    assert got[1][1] == 0 and got[2][:2] == (200_001, 200_000) and got[2][2] == b"x" and got[3][1] == 0


def test_rows_that_repeat_an_id(spark):
    """Each row loses what a smaller id holds; rows of one id take nothing from one another; ids are text."""
    rng = random.Random(6)
    rows = [(f"d{rng.randrange(12):02d}", " ".join(rng.choice("abc") for _ in range(rng.randrange(30)))) for _ in range(60)]
    rows += [rows[3], rows[3], rows[40], (rows[5][0], None), (None, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id string, text string, n int, row string").repartition(3)
    out = q.remove_spans(docs, q.repeated_spans(docs, 6, 3), 6)
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - 5):
            if i is not None:
                key = tuple(w[p : p + 6])
                first[key] = min(first.get(key, i), i)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 5):
            if i is not None and first[tuple(w[p : p + 6])] < i:
                gone[p : p + 6] = [True] * 6
        want.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g).encode()))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, bytes(r.kept)) for r in out.collect()) == sorted(want)
    assert {r.source[0] for r in q.maximal_spans(q.repeated_spans(docs, 6, 3), 6).collect()} == {"d"}


def test_empty_table_and_spans(spark):
    assert run(spark, []) == {}
    text = " ".join(f"t{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "a b " + text + " c")], "doc_id long, text string")
    got = [tuple(r) for r in q.maximal_spans(q.repeated_spans(docs)).collect()]
    assert got == [(2, 2, 62, 1)]


def test_digest(spark, data):
    row = q.op2_substring_dedup(spark, data).orderBy("doc_id").first()
    text = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").first().text
    assert row.kept_sha256 == hashlib.sha256(" ".join(WORD.findall(text)).encode()).hexdigest()


def test_texts_without_repeats_do_not_travel(tmp_path):
    """What joins move follows what repeats: it stays below half the bytes of a corpus with few repeats."""
    code = """
import random, sys
from pyspark.sql import SparkSession
from opslens.llm import substring_dedup as q
from opslens.session import configure
folder = sys.argv[1]
spark = SparkSession.builder.master("local[4]").config(map={
    "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{folder}/events", "spark.eventLog.compress": "false",
    "spark.eventLog.rolling.enabled": "false", "spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse",
}).getOrCreate()
spark = configure(spark)
rng = random.Random(7)
texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(2000)]
texts += texts[:20] + ["so " + t for t in texts[20:40]]
spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(f"{folder}/in/documents.parquet")
spark.sparkContext.setLocalProperty("opslens.test", "op2")
out = q.op2_substring_dedup(spark, f"{folder}/in").collect()
print("bytes", sum(map(len, texts)), "removed", sum(r.n_removed for r in out), "rows", len(out))
spark.stop()
"""
    (tmp_path / "events").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=root, env=os.environ | {"PYTHONPATH": root})
    said = done.stdout.split()
    assert said, done.stderr
    assert (int(said[3]), int(said[5])) == (40 * 400, 2040)
    mine, moved = set(), 0
    for line in open(next((tmp_path / "events").iterdir())):
        event = json.loads(line)
        if event["Event"] == "SparkListenerStageSubmitted" and event.get("Properties", {}).get("opslens.test") == "op2":
            mine.add(event["Stage Info"]["Stage ID"])
        if event["Event"] == "SparkListenerTaskEnd" and event["Stage ID"] in mine:
            moved += event["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"]
    assert 0 < moved < int(said[1]) / 2
