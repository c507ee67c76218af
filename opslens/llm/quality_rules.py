"""Rule ledger: every rule is evaluated once per document and kept as a bit next to its measurements.

Policies are versioned bit masks over that ledger, so a new policy, or the effect of leaving one
rule out, never reads the texts again. Built-in functions only.

Repeated windows are found by 64-bit hashes within one document: for a text of n words two different
windows are taken for equal with a chance of n * n / 2**65.

Defined results: a null or empty text has no words, all measurements 0 and fails ``few_words``;
repeated rows give one ledger row each; extra columns are ignored unless named in ``keep``; an
empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rules in bit order. A rule is a SQL condition over the measurements that is true when it fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "exclamations": "10 * n_exclamations > 3 * n_words",
}
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules that reject a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(rule) for rule in self.rules)


DEFAULT_POLICY = Policy("web", 1, tuple(RULES))
BASE_POLICY = Policy("base", 1, BASE)

BLANKS = "\\\\x20\\\\x09-\\\\x0D"
WORDS = f"array_remove(split(body, '[{BLANKS}]+'), '')"
LINES = f"filter(split(body, '\\n'), line -> line RLIKE '[^{BLANKS}]')"
# hashes of all 5-word windows; equal windows always have equal hashes
WINDOW_HASHES = """
transform(array(transform(words, w -> xxhash64(w))), h ->
  transform(sequence(0, size(words) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])))[0]"""
# positions of windows that stand twice or more, neighbours in hash order
REPEATED_POSITIONS = f"""
sort_array(transform(array(sort_array(transform({WINDOW_HASHES}, (h, i) -> struct(h AS h, i AS i)))), s ->
  transform(filter(s, (x, j) -> coalesce(x.h = get(s, j - 1).h, false) OR coalesce(x.h = get(s, j + 1).h, false)), x -> x.i))[0])"""
COVERED = f"""
aggregate({REPEATED_POSITIONS}, struct(0L AS n, -5 AS last),
  (a, p) -> struct(a.n + least(5, p - a.last) AS n, p AS last), a -> a.n)"""


def _count_of(chars: str) -> Column:
    left = F.col("body")
    for char in chars:
        left = F.replace(left, F.lit(char), F.lit(""))
    return (F.length("body") - F.length(left)).cast("long")


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep`` columns and every measurement."""
    out = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("body"))
    out = out.select(
        *keep,
        _count_of("#*$%&|<>").alias("n_symbols"),
        _count_of("!").alias("n_exclamations"),
        F.expr(LINES).alias("lines"),
        F.expr(WORDS).alias("words"),
    )
    out = out.select(
        *keep,
        "n_symbols",
        "n_exclamations",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr("size(lines) - size(array_distinct(lines))").cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.expr(
            f"CASE WHEN size(words) < 6 THEN 0L"
            f" WHEN size(array_distinct({WINDOW_HASHES})) = size(words) - 4 THEN 0L ELSE {COVERED} END"
        ).alias("n_repeat_words"),
    )
    return out


def with_failures(measured: DataFrame) -> DataFrame:
    """Adds ``failed``: bit i is set if rule i fails."""
    bits = [f"CASE WHEN {rule} THEN {1 << i}L ELSE 0L END" for i, rule in enumerate(RULES.values())]
    return measured.withColumn("failed", F.expr(" + ".join(bits)))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measurements and failure bits of every document."""
    return with_failures(measure(docs, text, keep))


def apply_policy(rows: DataFrame, policy: Policy = DEFAULT_POLICY, out: str = "kept") -> DataFrame:
    """Adds the verdict of a policy to ledger rows."""
    return rows.withColumn(out, F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablation(rows: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only this rule rejects.

    One aggregate over the bits; the union of all bits and the bits every document fails come along.
    """
    failed = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    names = list(RULES)
    marks = {rule: 1 << names.index(rule) for rule in policy.rules}
    counts = [F.count("*").alias("n_docs"), F.coalesce(F.bit_or(failed), F.lit(0)).alias("any_bits"), F.coalesce(F.bit_and(failed), F.lit(0)).alias("all_bits")]
    for rule, bit in marks.items():
        counts.append(F.count_if(failed.bitwiseAND(F.lit(bit).cast("long")) != 0).alias(f"fail_{rule}"))
        counts.append(F.count_if(failed == bit).alias(f"only_{rule}"))
    one = rows.agg(*counts)
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(rule).alias("rule"), F.col(f"fail_{rule}").alias("n_failed"), F.col(f"only_{rule}").alias("n_only"))
                for rule in policy.rules
            ]
        )
    ).alias("r")
    return one.select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "n_docs", "any_bits", "all_bits", each).select(
        "policy", "version", "n_docs", "any_bits", "all_bits", "r.*"
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of every document with the default policy's verdict."""
    rows = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("failed").bitwiseAND(F.lit(BASE_POLICY.mask).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "failed"
    )


QUERIES = {"op8_quality_rules": op8_quality_rules}

_SQL_SPACE = r"[\x20\x09-\x0D]+"
ORACLES = {
    "op8_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, body, list_filter(regexp_split_to_array(body, '{_SQL_SPACE}'), lambda x: x <> '') AS words,
        list_filter(string_split(body, chr(10)), lambda x: regexp_replace(x, '{_SQL_SPACE}', '', 'g') <> '') AS lines FROM d),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
win AS (SELECT doc_id, i, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4,
          lead(word, 4) OVER o AS w5 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w1, w2, w3, w4, w5) AS c FROM win WHERE w5 IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(5)) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(body, '{_SQL_SPACE}', '', 'g'))::BIGINT AS word_chars,
        (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (length(body) - length(replace(body, '!', '')))::BIGINT AS n_ex,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 10 * n_ex > 3 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, failed = 0 AS kept, n_lines, failed FROM f
"""
}
