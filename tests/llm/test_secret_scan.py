import random
import re

from opslens.llm import secret_scan as q

RUN = re.compile(r"[A-Za-z0-9_+/=.\-]{16,}")


def by_hand(text):
    return [(m.start(), m.end(), m.group()) for m in RUN.finditer(text or "") if re.search("[0-9]", m.group()[:201])]


def corpus():
    rng = random.Random(8)
    rows, secrets = [], set()
    for i in range(300):
        words = [rng.choice(["lorem", "ipsum", "dolor", "ünder"]) for _ in range(25)]
        for _ in range(3):
            hexed = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            words.insert(rng.randrange(len(words)), rng.choice([f'token = "{hexed}"', f"api_key: {hexed}", "".join(rng.choice("0123456789") for _ in range(16)), f"mail{i}.example-host.com", "lorem/ipsum/dolor_2/file.txt"]))
        text = " ".join(words)
        rows.append((i, text, "clash"))
        secrets |= {(i, s) for s, e, f in by_hand(text) if re.fullmatch("[0-9a-f]{40}", f)}
    rows += [(900, None, ""), (901, "", ""), (902, "nothing here", ""), (903, "a1" * 100_000, ""), (904, ("1234567890123456 " * 3000), ""), (905, 'token = "' + "ab12" * 10 + '"', ""), (905, 'token = "' + "ab12" * 10 + '"', "")]
    return rows, secrets


def test_candidates_and_forest(spark):
    rows, secrets = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, finding string").repartition(3)
    found = q.candidates(docs).collect()
    expected = sorted((i, *c) for i, t, _ in rows for c in by_hand(t))
    assert sorted((r.doc_id, r.start, r.end, r.finding) for r in found) == expected
    out = q.scan(docs).collect()
    got = {(r.doc_id, r.start) for r in out if r.is_secret and r.doc_id < 900}
    assert len(out) == len(expected) and got == secrets
    assert sum(r.doc_id == 905 and r.is_secret for r in out) == 2 and not any(r.is_secret for r in out if r.doc_id == 904)
    plan = q.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def forms():
    """Texts with secrets in the forms that configurations, shells and headers have, and what the finding is."""
    rng = random.Random(9)
    made = lambda n, chars="ABCDEFGHKLMNPQRSTabcdefghkmnpqrstuv23456789": "".join(rng.choice(chars) for _ in range(n - 1)) + "7"
    rows = []
    for i in range(400):
        secret = made(rng.choice([24, 40]))
        text = [f"export AWS_SECRET_ACCESS_KEY={secret}", f"api_key={secret}", f"Authorization: Bearer {secret}", f"run it with --password={secret}== now", f"Authorization: Basic {secret}", f"MY_TOKEN = '{secret}'", f'"client_secret": "{secret}"'][i % 7]
        filler = " ".join(rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(20))
        other = rng.choice([made(16, "0123456789"), f"lorem/ipsum{i}/dolor_2/file.txt", f"mail{i}.example-host.com", f"commit {made(40, '0123456789abcdef')}"])
        rows.append((i, f"{text}\n{filler} {other} {filler}", secret))
    return rows


def test_names_and_schemes(spark):
    rows = forms()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    texts, own = {r[0]: r[1] for r in rows}, {(r[0], r[1].index(r[2])) for r in rows}
    found = q.with_features(q.candidates(docs), []).cache()
    labels = {(r.doc_id, r.start): r.label for r in q.cue_labels(found).collect()}
    assert {labels.get(at) for at in own} == {1} and {v for at, v in labels.items() if at not in own} == {0}
    out = q.scan(docs).collect()
    assert all(texts[r.doc_id][r.start : r.end] == r.finding for r in out)
    assert {(r.doc_id, r.start) for r in out if r.is_secret} == own


def weak():
    """Secrets that are short, have no digit, or have it late."""
    rng = random.Random(10)
    made = lambda n, chars="ABCDEFGHKLMNPQRSTabcdefghkmnpqrstuv": "".join(rng.choice(chars) for _ in range(n))
    rows = []
    for i in range(300):
        secret = [made(7, "abcdefghkm") + "7xyz", made(19, "abcdefghkmnprst"), made(16), made(8, "abcdefgh2345"), made(230) + "7"][i % 5]
        text = [f'password: "{secret}"', f'password = "{secret}"', f"token = '{secret}'", f"pwd={secret}", f"secret: {secret}"][i % 5]
        filler = " ".join(rng.choice(["lorem", "ipsum", "dolor", "consectetuer", "note: incididunt", "internationalisation"]) for _ in range(20))
        rows.append((i, f"{filler}\n{text}\n{filler} {rng.randrange(10**15, 10**16)} {filler}", secret))
    return rows


def test_weak_secrets(spark):
    rows = weak()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    out = q.scan(docs).collect()
    own = {(r[0], r[1].index(r[2]), r[2]) for r in rows}
    assert own <= {(r.doc_id, r.start, r.finding) for r in out}
    found = {(r.doc_id, r.start, r.finding) for r in out if r.is_secret}
    assert own <= found and len(found - own) < 0.01 * (len(out) - len(own))


def test_gate(spark):
    texts = ['password: "hunter2xyz"', 'password = "correcthorsebattery"', "pwd=hunter2x", "Bearer abcdefgh", "x" * 300 + "1", "QwErTyUiOpAsDfGh", "password hunter2xyz", "------------------------", "short words, nothing here", "a1b2c3d4 alone"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.finding for r in q.candidates(docs).collect()}
    assert found == dict(enumerate(["hunter2xyz", "correcthorsebattery", "hunter2x", "abcdefgh", "x" * 300 + "1", "QwErTyUiOpAsDfGh", "hunter2xyz"]))


def test_uncertain_is_not_taught(spark):
    texts = ["9f8b7c6d5e4f3a2b1c0d", "use 9f8b7c6d5e4f3a2b1c0d here", "the basic internationalization", "token: internationalization9", "author: maximilian-friedrich9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r.doc_id: r.label for r in q.cue_labels(q.with_features(q.candidates(docs), [])).collect()}
    assert labels == {3: 1}


def test_given_labels(spark):
    docs = spark.createDataFrame([(i, f"x{'1' if i % 2 else 'a'}{'0123456789abcdef'[: 16 + i % 3]}9 end") for i in range(40)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, start long, label int")
    assert {r.score for r in q.scan(docs, none).collect()} == {0.0}
    all_secret = spark.createDataFrame([(i, 0, 1) for i in range(40)] + [(1, 5, None)], "doc_id long, start long, label int")
    assert {r.score for r in q.scan(docs, all_secret).collect()} == {1.0}
    own = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, start long, label int")
    assert all(r.is_secret == bool(r.doc_id % 2) for r in q.scan(docs, own).collect())


def test_dictionary_covers_all_documents(spark):
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(2500)]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "doc_id long, text string")
    assert q.dictionary(docs, size=3000) == sorted(names)


def test_empty_table(spark):
    assert q.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_findings_of_many_segments(spark):
    """No pattern goes deeper with the segments of a path."""
    long = ["ab/" * 100_000 + "cd.py", "ab." * 100_000 + "cd", "a1/b2." * 50_000, "key=" * 50_000 + "v" * 20, ("x" * 20 + "=") * 20_000]
    rows = [(i, f'see {text} and token = "{"ab12" * 10}" here') for i, text in enumerate(long)]
    docs = spark.createDataFrame([r[:2] for r in corpus()[0]] + [(1000 + i, t) for i, t in rows], "doc_id long, text string")
    out = q.scan(docs).collect()
    assert {r.doc_id for r in out} >= {1000 + i for i, _ in rows}
    assert len({r.doc_id for r in out if r.doc_id >= 1000 and r.is_secret}) == len(rows)
