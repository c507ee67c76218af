import random
import re
import time

import numpy as np

from opslens.llm import pii as q
from opslens.llm.boosting import BoostedTrees, fit_folds

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fine(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1]))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def by_hand(text):
    found = [(m.start(), k, m.end()) for k, kind in enumerate(q.KINDS) for m in re.finditer(PATTERNS[kind], text) if fine(kind, m.group())]
    return sorted(found)


def test_base_spans_against_plain_patterns():
    rng = random.Random(1)
    parts = ["a@b.co", "@", ".", "-", " ", "x_y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "+1 (017) 555-7713", "+", "(", ")", "00", "é", "7", "a.b", "@c", "@d.e", "\n", "5500-0000-0000-0004"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert q.base_spans(text) == by_hand(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000 + " a@b.co", "a" * 300_000 + "@", "a@b" * 100_000, "+1" + " " * 300_000, "1." * 200_000, "1-" * 200_000, "a." * 100_000 + "@b.co", "1 " * 150_000, "x at " * 50_000):
        q.Model(thresholds=[0.0] * 4).spans(text[:1] + text)
        q.candidates(text)


def test_many_spans_take_linear_time():
    class Sure:
        def predict(self, x):
            return np.ones(len(x))

    def brute(text, base):
        out = []
        for c in q.candidates(text):
            if not any(s < c[2] and c[0] < e for s, _, e in base + out):
                out.append(c)
        return sorted(out)

    model = q.Model(trees=Sure(), thresholds=[0.5] * 4)
    rng = random.Random(5)
    parts = ["a@b.co", "jo at mail dot com", "1.2.3.4", "1,2,3,4", "555 1234 999", "4111.1111.1111.1111", " ", "x", "+1 017 555 7713", ", "]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(12))
        assert model.added(text, q.base_spans(text)) == brute(text, q.base_spans(text)), text
    text = "jo at mail dot com, a@b.co, " * 50_000
    begun = time.process_time()
    base = q.base_spans(text)
    mark = q._cover(len(text), base)
    assert sum(mark.find(1, c[0], c[2]) < 0 for c in q.candidates(text)) == 50_000 == len(base)
    assert time.process_time() - begun < 5


def test_boosting_learns():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    p = BoostedTrees().fit(x[:1500], y[:1500]).predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.95
    assert len(BoostedTrees().predict(np.zeros((0, 5)))) == 0


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        words = [rng.choice(["lorem", "ipsum", "dolor", "sit", "é"]) for _ in range(30)]
        extra = [f"n{i}.{i}@mail{i % 9}.example.com", f"{rng.randrange(1, 255)}.{rng.randrange(255)}.3.{rng.randrange(255)}", f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", str(rng.randrange(10**15, 10**16)), f"{rng.randrange(300, 999)}.{rng.randrange(300, 999)}.1.1"]
        for e in rng.sample(extra, 3):
            words.insert(rng.randrange(len(words)), e)
        rows.append((i, " ".join(words), i, "x"))
    rows += [(900, None, None, ""), (901, "", 0, ""), (902, "none here", 9, ""), (903, "a@b.co " * 2000, 14_000, ""), (904, "x a@b.co", 8, "")] + [(905, "call +1 (017) 555-7713", 22, "")] * 2
    return rows


def test_find_and_redact(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string").repartition(3)
    model = q.train(docs)
    out = q.find(docs, model).collect()
    assert len(out) == len(rows)
    texts = {i: t or "" for i, t, *_ in rows}
    for r in out:
        base = by_hand(texts[r.doc_id])
        assert r.base == ",".join(f"{q.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    kept = {r.doc_id: r for r in q.redact(docs, model).collect()}
    assert q.redact(docs, model).columns == docs.columns and kept[900].text is None and kept[902].text == "none here"
    assert kept[904].text == "x [EMAIL]" and kept[904].n_chars == 9 and kept[905].text == "call [PHONE]"
    assert not any(q.base_spans(r.text) for r in kept.values() if r.text)
    assert q.redacted("abcdef", [(0, 0, 3), (2, 1, 4), (5, 3, 6)]) == "[EMAIL]e[PHONE]"


def test_finds_planted_spans_beyond_the_base(spark):
    rng = random.Random(4)
    rows = [r[:2] for r in corpus()]
    prose = ["we met at home. Then it rained", "look at this. Well", "on 2024-01-15 10:30", "pages 12 14 16", "version 999.812.300.411", "on 03/04/2021 at noon"]
    for i, (d, text) in enumerate(rows):
        if d < 300:
            rows[i] = d, f"{text} mail a{d}.b@mail{d % 7}.example.com, call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} lorem {prose[d % 6]} ipsum"
    planted = {}
    for i in range(60):
        body = [f"jane{i} at mail dot com", f"jo{i} [at] mail{i} [dot] example [dot] org", f"k.l{i}(at)host.com", f"1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", f"001 {rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)}"][i % 5]
        text = f"lorem ipsum dolor {'mail' if i % 5 < 3 else 'call'} {body} lorem ipsum"
        assert not q.base_spans(text)
        planted[1000 + i] = text, text.index(body), text.index(body) + len(body)
        rows.append((1000 + i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = q.train(docs)
    found = {r.doc_id: r.spans for r in q.find(docs, model).collect()}
    hit = [d for d, (_, start, end) in planted.items() if f"{'email' if d % 5 < 3 else 'phone'}:{start}:{end}" in found[d]]
    assert len(hit) >= 0.9 * len(planted), (len(hit), model.thresholds)
    assert not any(model.spans(f"lorem {p} ipsum")[1] for p in prose)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = q.train(docs)
    assert q.find(docs, model).count() == 0 and q.redact(docs, model).count() == 0


def test_other_columns_called_n_chars(spark):
    docs = spark.createDataFrame([(i, f"write to user{i}@mail.com now", "many", 1.5) for i in range(40)], "doc_id long, text string, n_chars string, spans double")
    out = q.redact(docs, q.train(docs)).collect()
    assert all("@" not in r.text and r.n_chars == "many" and r.spans == 1.5 for r in out)


def test_learns_from_all_candidates(spark):
    """Thirty spans among 60,000 candidates that are none: too few of them are in a sample of 20,000."""
    rows = [(k, " lorem ".join(f"v{k}x{i} 999.{300 + i % 700}.{300 + k}.1" for i in range(1000))) for k in range(60)]
    rows += [(100 + k, f"call +{10 + k % 80} 555 {1000 + 37 * k} lorem") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = q.train(docs.repartition(3))
    assert model.thresholds[q.KINDS.index("phone")] <= 1
    other = q.train(docs.repartition(7, "text"))
    assert (other.trees.splits == model.trees.splits).all() and (other.trees.leaves == model.trees.leaves).all() and other.thresholds == model.thresholds


def test_boosting_over_a_table_equals_arrays(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, size=(3000, 4)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 5)).astype(int)
    want = BoostedTrees(rounds=12).fit(x, y)
    got = [BoostedTrees(rounds=12, cuts=want.cuts) for _ in range(2)]
    for trees in got:
        trees.start(y.mean())
    rows = [(b.tobytes(), int(label), 0, 2) for b, label in zip(want.binned(x).astype(np.uint8), y)]
    cells = spark.createDataFrame(rows, "bins binary, y int, fold int, n long").repartition(5)
    # no row is of fold 1, so the second model sees them all; twice each, so with half the ridge
    got[1].ridge *= 2
    total = fit_folds(cells, 4, got, lambda block: np.array([s.sum() for s in block["scores"]]))
    assert (got[0].leaves == 0).all() and (got[1].splits == want.splits).all() and np.allclose(got[1].leaves, want.leaves)
    assert np.allclose(total, [3000 * got[0].base, want.score(want.binned(x), np.full(3000, want.base), 0, 12).sum()])
