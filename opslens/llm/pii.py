"""Personal data: generous candidate generators, boosted trees, calibrated thresholds.

Spans of the four base formats (email, ip, card, phone) are always found. Generators propose more spans of
these kinds, overlapping each other: spaced or spelled-out addresses, numbers without a leading
plus, long digit runs, addresses with odd separators. Boosted trees judge them by format (length,
digits, separators, grouping) and context (characters and words around, other findings in the text).
They learn from all distinct candidates of the table: base spans, and base spans rewritten in place into the
generators' other forms, against candidates that are none. What keeps its kind's base rule and stands
by a cue, and an address spelled out with brackets or dots, may be real and teaches nothing. Per kind
the threshold is the lowest one (of 4,096) whose out-of-fold precision over rewritten spans and others, the rows
of one span counting as one, reaches ``PRECISION``; a kind without such a threshold adds nothing. Added spans never overlap base spans.

Defined results: null and empty texts have no span; spans of different kinds may overlap and are
redacted as one; repeated rows give one row each; extra columns are ignored, and kept by ``redact``;
an empty table gives an empty result. All scans take time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.llm.boosting import BoostedTrees, fit_folds
from opslens.llm.textnum import buffers, chunks
from opslens.session import scratch_path

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
LEAST = 20  # candidates above a threshold that has to be trusted
FOLDS = 3
WHOLE = 60  # weight of a span; its rewritten forms, six at most, share it
PART = 50_000  # candidates per task, so that a pass over them takes longer than to start it
GRID = 4096  # a threshold is a multiple of the inverse; no power of two is rounded

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AT_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a quad starts where a digit run starts; starting inside the run would end at the same place
QUAD = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
DIGITS = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# generators; every quantifier is bounded or cannot match again what it gave up
GENERATORS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(] ?at ?[\])] ?| ?@ ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?\. ?| ?[\[(] ?dot ?[\])] ?| dot )[A-Za-z]{2,63}){1,4}"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?[.,:] ?[0-9]{1,3}){3}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ .\-/]?[0-9]{2,6}){2,4}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ .\-/]{1,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9])"),
}
CUES = {
    "email": re.compile(r"mail|contact|write", re.I),
    "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|credit|account|konto|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|ruf|appel|llam", re.I),
}
NEAR = 24  # characters of context on either side
AROUND = 100  # characters kept beside a rewritten span
DOT = re.compile(r" dot |[\[(] ?dot ?[\])]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base formats, sorted."""
    out = []
    if "@" in text:
        free, last = 0, -1
        for m in AT_HOST.finditer(text):
            at = m.start()
            last = text.rfind("@", free, at)
            lo = max(free, last + 1)
            start = lo + len(text[lo:at].rstrip(LOCAL))
            if start < at:
                out.append((start, 0, m.end()))
                free = m.end()
    for m in QUAD.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PLUS.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of everything the generators propose."""
    return sorted({(m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in GENERATORS[kind].finditer(text)})


def features(text: str, span: tuple[int, int, int], n_base: int) -> list[float]:
    """Format and context of one candidate. The base rules' verdicts are no features."""
    start, kind, end = span
    body = text[start:end]
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    digits = [c for c in body if "0" <= c <= "9"]
    groups = re.split(r"[^0-9]+", body.strip("+()"))
    last = re.split(r"[^A-Za-z]+", body)[-1]
    cue = CUES[KINDS[kind]].search(before)
    return [
        float(kind),
        float(len(body)),
        float(len(digits)),
        sum(c.isalpha() for c in body) / len(body),
        float(body.count(" ")),
        float(sum(c in ".-/(),:" for c in body)),
        float("[" in body or "(" in body),
        float(bool(DOT.search(body))),
        float(len(last)),
        float(last[:1].isupper()),
        float(len(groups)),
        float(max(map(len, groups))),
        float(min(map(len, groups))),
        len(set(digits)) / max(len(digits), 1),
        float(max((int(g[-6:]) for g in groups if g), default=0)),
        float(bool(cue)),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        float(before[-1:] in ("", " ", "\n")),
        float(after[:1] in ("", " ", "\n", ".", ",")),
        sum(c.isalpha() for c in before) / max(len(before), 1),
        sum(c.isdigit() for c in before + after) / max(len(before + after), 1),
        float(min(n_base, 5)),
    ]


N_FEATURES = 23


def rewritten(text: str, span: tuple[int, int, int]) -> list[tuple[str, tuple[int, int, int]]]:
    """A base span in the other forms its generator knows, each as (text around, span in it)."""
    start, kind, end = span
    body = text[start:end]
    digits = re.sub("[^0-9]", "", body)
    if kind == 0:
        user, _, host = body.rpartition("@")
        forms = [f"{user} at {host.replace('.', ' dot ')}", f"{user} [at] {host.replace('.', ' [dot] ')}", f"{user}(at){host}", f"{user} at {host}", f"{user} @ {host}"]
    elif kind == 1:
        forms = [body.replace(".", mark) for mark in (",", ":", " . ")]
    elif kind == 2:
        forms = [mark.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for mark in "./"]
    else:
        plain = re.sub("[^0-9]+", " ", body[1:]).strip()
        forms = [body[1:], "00" + body[1:], *(plain.replace(" ", mark) for mark in " ./-")]
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    out = []
    for form in dict.fromkeys(forms):
        near = before + form + after
        for m in GENERATORS[KINDS[kind]].finditer(near):
            if m.start() == len(before) and m.end() >= len(before) + len(form):
                out.append((near, (m.start(), kind, m.end())))
    return out


def may_be_real(text: str, span: tuple[int, int, int]) -> bool:
    """Whether a candidate that is no base span says enough for itself not to count as a negative."""
    start, kind, end = span
    body = text[start:end]
    if kind == 0:
        return bool(DOT.search(body)) or "[" in body or "(" in body
    digits = re.sub("[^0-9]", "", body)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    fits = all(int(p) <= 255 for p in re.findall("[0-9]+", body)) if kind == 1 else 9 <= len(digits) <= 15
    return fits and bool(CUES[KINDS[kind]].search(text[max(0, start - NEAR) : start]))


@dataclass
class Model:
    trees: BoostedTrees = field(default_factory=BoostedTrees)
    thresholds: list[float] = field(default_factory=lambda: [2.0] * len(KINDS))

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates above their kind's threshold that overlap neither a base span nor a better candidate."""
        taken = _cover(len(text), base)
        free = [c for c in candidates(text) if self.thresholds[c[1]] <= 1 and taken.find(1, c[0], c[2]) < 0]
        if not free:
            return []
        p = self.trees.predict(np.array([features(text, c, len(base)) for c in free], "<f4"))
        good = sorted(((-v, c) for v, c in zip(p.tolist(), free) if v >= self.thresholds[c[1]]))
        out: list[tuple[int, int, int]] = []
        for _, c in good:
            if taken.find(1, c[0], c[2]) < 0:
                taken[c[0] : c[2]] = b"\1" * (c[2] - c[0])
                out.append(c)
        return out

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Base spans, and all spans."""
        base = base_spans(text)
        return base, sorted(base + self.added(text, base))


def _cover(size: int, spans: list[tuple[int, int, int]]) -> bytearray:
    """A mark for every character inside a span. A candidate is short, so looking it up is cheap however many spans there are."""
    mark = bytearray(size)
    for start, _, end in spans:
        mark[start:end] = b"\1" * (end - start)
    return mark


def _texts(part: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    """Rows whose text has a digit or an at-sign, or spells one out."""
    data, offsets = buffers(part.column("text"))
    mark = np.zeros(256, bool)
    mark[[*range(48, 58), 64]] = True
    seen = np.concatenate([[0], np.cumsum(mark[data])])
    hit = seen[offsets[1:]] > seen[offsets[:-1]]
    raw = data.tobytes()
    for i in range(len(part)):
        if hit[i] or b" at " in raw[offsets[i] : offsets[i + 1]] or b"at)" in raw[offsets[i] : offsets[i + 1]] or b"at]" in raw[offsets[i] : offsets[i + 1]]:
            yield i, raw[offsets[i] : offsets[i + 1]].decode()


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features, label and weight of base spans (weight 0), rewritten base spans and candidates that are none."""
    for batch in batches:
        for part in chunks(batch):
            rows, keys = [], []

            def add(text: str, c: tuple[int, int, int], n_base: int, label: float, weight: float, rows=rows, keys=keys) -> None:
                rows.append(np.array([*features(text, c, n_base), label, weight], "<f4").tobytes())
                near = text[max(0, c[0] - 30) : c[2] + 30].encode()
                keys.append(int.from_bytes(hashlib.blake2b(near, digest_size=8).digest(), "little", signed=True))

            for _, text in _texts(part):
                base = base_spans(text)
                exact = set(base)
                taken = _cover(len(text), base)
                for c in candidates(text):
                    if c in exact:
                        add(text, c, len(base) - 1, 1.0, 0.0)
                    elif taken.find(1, c[0], c[2]) < 0 and not may_be_real(text, c):
                        add(text, c, len(base), 0.0, WHOLE)
                for b in base:
                    forms = rewritten(text, b)
                    for near, c in forms:
                        add(near, c, len(base) - 1, 1.0, WHOLE // len(forms))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.binary())], ["key", "row"])


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features, label and weight as a table, and the fold of each row."""
    table = np.frombuffer(b"".join(batch.column("row").to_pylist()), "<f4").reshape(-1, N_FEATURES + 2)
    return table.astype(float), np.asarray(batch.column("key")) % FOLDS


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each value of each feature occurs, and each label in each fold (behind the features)."""
    for batch in batches:
        table, fold = _rows(batch)
        columns = [*table[:, :N_FEATURES].T, *(table[fold == k, N_FEATURES] for k in range(FOLDS))]
        for j, column in enumerate(columns):
            value, n = np.unique(column, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), j, np.int32)), pa.array(value), pa.array(n)], ["column", "value", "n"])


def train(docs: DataFrame) -> Model:
    """Trees and thresholds from all distinct candidates of all documents.

    Candidates of the same bins are one row with a count. Sums over them are whole numbers, so the model is the
    same whatever the partitioning. The driver sees value bins, sums by tree node and counts by score.
    """
    spark = docs.sparkSession
    found = docs.select("text").mapInArrow(_labelled, "key long, row binary").groupBy("key").agg(F.min("row").alias("row"))
    where = scratch_path(spark, "candidates")
    found.write.parquet(where)
    rows = spark.read.parquet(where)

    model, held = Model(), [BoostedTrees() for _ in range(FOLDS)]
    counts = rows.mapInArrow(_values, "column int, value double, n long").groupBy("column", "value").agg(F.sum("n").alias("n"))
    quantiles = F.percentile("value", model.trees.quantiles(), F.col("n")).alias("cuts")
    seen = {r["column"]: r for r in counts.groupBy("column").agg(quantiles, F.sum("n").alias("n"), F.sum(F.col("value") * F.col("n")).alias("ones")).collect()}
    size, ones = (np.array([seen[j][name] if j in seen else 0 for j in range(N_FEATURES, N_FEATURES + FOLDS)]) for name in ("n", "ones"))
    if not 0 < ones.sum() < size.sum():
        return model
    cuts = [np.unique(seen[j]["cuts"]) for j in range(N_FEATURES)]
    for k, trees in enumerate([*held, model.trees]):
        trees.cuts = cuts
        rest = np.arange(FOLDS) != k
        trees.start(ones[rest].sum() / max(size[rest].sum(), 1))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, fold = _rows(batch)
            bins = model.trees.binned(table[:, :N_FEATURES]).astype(np.uint8)
            kind, y, weight = (table[:, j].astype(np.int32) for j in (0, N_FEATURES, N_FEATURES + 1))
            columns = [pa.array([b.tobytes() for b in bins], pa.binary()), *map(pa.array, (kind, y, weight, fold.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, ["bins", "kind", "y", "weight", "fold"])

    same = ["bins", "kind", "y", "weight", "fold"]
    cells = rows.mapInArrow(binned, "bins binary, kind int, y int, weight int, fold int").groupBy(*same).agg(F.count(F.lit(1)).alias("n"))

    def by_score(block: dict[str, np.ndarray]) -> np.ndarray:
        """Rows, weight and weight of positives by kind and score by trees that have not seen the row. Base spans are
        found anyway; what counts are the rows that stand for spans to be added."""
        out = np.zeros((len(KINDS), GRID + 1, 3), np.int64)
        p = 1 / (1 + np.exp(-np.choose(block["fold"], block["scores"][:FOLDS])))
        n, weight = block["n"] * (block["weight"] > 0), block["weight"] * block["n"]
        np.add.at(out, (block["kind"], (p * GRID).astype(int)), np.stack([n, weight, weight * block["y"]], 1))
        return out

    parts = int(size.sum() // PART) + 1
    for k, counts in enumerate(fit_folds(cells.coalesce(parts), N_FEATURES, [*held, model.trees], by_score)):
        n, total, right = counts[::-1].cumsum(0).T
        fine = np.flatnonzero((counts[::-1, 0] > 0) & (n >= LEAST) & (right >= PRECISION * total))
        if len(fine):
            model.thresholds[k] = max((GRID - int(fine[-1])) / GRID, 0.5)
    return model


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans): base counts, base spans and all spans as text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                n = np.zeros((len(part), len(KINDS)), np.int64)
                base, spans = [""] * len(part), [""] * len(part)
                for i, text in _texts(part):
                    own, everything = model.spans(text)
                    np.add.at(n[i], [k for _, k, _ in own], 1)
                    base[i], spans[i] = _named(own), _named(everything)
                columns = [part.column("doc_id"), *(pa.array(n[:, k]) for k in range(len(KINDS))), pa.array(base, pa.string()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(found, f"doc_id {kind}, {counts}, base string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with all spans redacted; a column ``n_chars`` of whole numbers follows the text, one of
    another type is an extra column and stays as it is."""
    names = docs.columns
    counted = dict(docs.dtypes).get("n_chars") in ("int", "bigint")

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                new = {}
                for i, text in _texts(part):
                    # a number that ran into another one can stand alone once that one is gone
                    while spans := model.spans(text)[1]:
                        text = new[i] = redacted(text, spans)
                if new:
                    columns = {name: part.column(name) for name in names}
                    texts = part.column("text").to_pylist()
                    sizes = part.column("n_chars").to_pylist() if counted else []
                    for i, text in new.items():
                        texts[i] = text
                        if sizes:
                            sizes[i] = len(text)
                    columns["text"] = pa.array(texts, part.schema.field("text").type)
                    if sizes:
                        columns["n_chars"] = pa.array(sizes, part.schema.field("n_chars").type)
                    part = pa.RecordBatch.from_arrays([columns[n] for n in names], names)
                yield part

    return docs.mapInArrow(changed, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = find(docs, train(docs))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


QUERIES = {"op10_pii": op10_pii}
