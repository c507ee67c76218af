"""Hard negatives of anchors, from exact integer scores by Kronecker-packed products.

Components are integers. Those of several rows are raised above zero and put side by side into fields of
one wide integer; a product with an anchor's component (raised likewise) multiplies all fields at once, and the
field width leaves room for the whole sum, so the fields of the summed products are exact. The raise is
taken off again by the sums of the components. Field widths follow from each block's own components: 64-bit
integers hold two or three rows for usual embeddings; where one field does not fit, Python's integers do it.

Rows are numbered, written once and dealt to blocks of about 4,096 rows by a hash of the number, anchors to
blocks of about 1,024; each block of rows meets each block of anchors in one task. A first round keeps
the best rows of the anchor's label per block and then over all blocks, a second one the best rows of other
labels inside each positive's bounds. Nothing is kept that grows with the rows: a few rows per block and anchor.

Defined results: rows with a null id, label or vector, or any null or non-finite component take no part;
shorter vectors count as if filled up with zeros; rows with equal ids are rows like any other (an anchor's
twin can be its positive), and each anchor row brings its own result; scores beyond 64 bits are cut to
the limits of a long; anchors without positives and positives without negatives give no row; an empty
table gives none; extra columns are ignored. Ids may be of any type with an order; ``limit``s are per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from opslens.session import scratch_path

ROWS, ANCHORS = 4096, 1024  # about so many in a block
AT_ONCE = 128  # anchors whose scores stand in memory together, times ROWS
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score in per cent of the positive's
_LONG = 2**63 - 1


def fields_of(rows: np.ndarray, anchors: np.ndarray) -> int:
    """Bits of a field that holds raised components and any sum of their products."""
    high = [int(x.max()) - int(x.min()) if x.size else 0 for x in (rows, anchors)]
    return max(1, *high, rows.shape[1] * high[0] * high[1]).bit_length()


def products(rows: np.ndarray, anchors: np.ndarray, word: int = 64) -> np.ndarray:
    """Exact inner products (anchor, row) of integer matrices; int64, or Python's integers if they need it."""
    (n, d), m = rows.shape, len(anchors)
    if not n or not m or not d:
        return np.zeros((m, n), np.int64)
    raise_r, raise_a = -int(rows.min()), -int(anchors.min())
    bits = fields_of(rows, anchors)
    small = bits <= word
    count = max(1, word // bits) if small else max(1, 960 // bits)
    kind = np.uint64 if small else object
    # the exact score is at most this
    biggest = d * max(abs(int(rows.min())), abs(int(rows.max()))) * max(abs(int(anchors.min())), abs(int(anchors.max())))
    whole = np.int64 if biggest < 2**61 and rows.dtype != object and anchors.dtype != object else object
    up_r = (rows.astype(whole) + raise_r).astype(kind)
    up_a = (anchors.astype(whole) + raise_a).astype(kind)
    packed = np.zeros((-(-n // count), d), kind)
    for f in range(count):
        part = up_r[f::count]
        packed[: len(part)] |= part << (np.uint64(bits * f) if small else bits * f)
    total = np.zeros((m, len(packed)), kind)
    for j in range(d):
        total += up_a[:, j, None] * packed[None, :, j]
    raw = np.zeros((m, n), whole)
    mask = (1 << bits) - 1
    for f in range(count):
        width = len(range(f, n, count))
        shifted = total[:, :width] >> (np.uint64(bits * f) if small else bits * f)
        raw[:, f::count] = (shifted & (np.uint64(mask) if small else mask)).astype(whole)
    # sum (r + R)(a + A) = sum r a + A sum (r + R) + R sum (a + A) - d R A
    raw -= raise_a * up_r.astype(whole).sum(axis=1)[None, :]
    raw -= raise_r * up_a.astype(whole).sum(axis=1)[:, None]
    return raw + d * raise_r * raise_a


def _numbered(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Rows that take part, numbered, with floor(scale * component) as bytes of 32-bit integers or doubles."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        vectors = batch.column("vector")
        flat = vectors.flatten().cast(pa.float64())
        size = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
        values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        broken = np.append(0, np.cumsum(~np.isfinite(values)))
        good = broken[ends] == broken[ends - size]
        good &= ~np.array(batch.column("anchor").is_null()) & ~np.array(batch.column("id").is_null())
        good &= ~np.array(batch.column("label").is_null()) & ~np.array(vectors.is_null())
        kept = np.flatnonzero(good)
        if not len(kept):
            continue
        with np.errstate(over="ignore"):
            scaled = np.floor(values * scale)
        # a product that leaves the range of doubles stays at its end
        scaled = np.nan_to_num(scaled, posinf=np.finfo(np.float64).max, neginf=-np.finfo(np.float64).max)
        blobs = []
        for i in kept.tolist():
            v = scaled[ends[i] - size[i] : ends[i]]
            blobs.append((v.astype("<i4") if not len(v) or np.abs(v).max() < 2**31 else v.astype("<f8")).tobytes())
        rows = pa.array(kept)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(number + np.arange(len(kept))),
                batch.column("id").take(rows),
                batch.column("label").take(rows),
                batch.column("anchor").take(rows),
                pa.array(size[kept].astype(np.int32)),
                pa.array(blobs, pa.binary()),
            ],
            ["no", "id", "label", "anchor", "dims", "vector"],
        )
        number += len(kept)


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    out = np.zeros((len(table), dims), np.int64)
    for i, (blob, d) in enumerate(zip(table.column("vector").to_pylist(), table.column("dims").to_pylist())):
        if d and len(blob) == 8 * d:
            # far beyond 32 bits: Python's integers from here on
            out = out.astype(object)
            out[i, :d] = [int(x) for x in np.frombuffer(blob, "<f8")]
        else:
            out[i, :d] = np.frombuffer(blob, "<i4")
    return out


class _Block:
    """Scores of the rows of one block against the anchors of another, as sorted keys."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        rows = rows.sort_by([("id", "ascending"), ("no", "ascending")])
        self.no, self.id = rows.column("no").to_numpy(), rows.column("id").combine_chunks()
        self.label = np.array(rows.column("label").to_pylist())
        self.anchor_no = anchors.column("no").to_numpy()
        self.anchor_label = np.array(anchors.column("label").to_pylist())
        dims = max(max(t.column("dims").to_pylist(), default=0) for t in (anchors, rows))
        self.vectors, self.queries = _matrix(rows, dims), _matrix(anchors, dims)

    def keys(self, same_label: bool) -> Iterator[tuple[int, np.ndarray, int, int]]:
        """(anchor, keys, least score, highest score): a key is score above the least one times the rows, plus
        how many rows come later; rows that do not count have -1. Sorted, so the best are last."""
        n = len(self.no)
        later = np.arange(n - 1, -1, -1)
        for at in range(0, len(self.anchor_no), AT_ONCE):
            scores = products(self.vectors, self.queries[at : at + AT_ONCE])
            least, most = int(scores.min()), int(scores.max())
            if (most - least + 2) * n >= 2**62:
                scores = scores.astype(object)
            keys = (scores - least) * n + later
            equal = self.anchor_label[at : at + AT_ONCE, None] == self.label[None, :]
            own = self.anchor_no[at : at + AT_ONCE, None] == self.no[None, :]
            keys[(equal != same_label) | own] = -1
            keys.sort(axis=1)
            for i, row in enumerate(keys):
                yield at + i, row, least, most


def _found(found: list[tuple], ids: pa.Array, names: list[str]) -> pa.Table:
    columns = list(zip(*found)) or [[]] * len(names)
    limited = lambda x: pa.array([max(-_LONG - 1, min(_LONG, v)) for v in x], pa.int64())
    arrays = [ids.take(pa.array(c, pa.int64())) if n == "id" else limited(c) for n, c in zip(names, columns)]
    return pa.table(dict(zip(names, arrays)))


def _best_same(rows: pa.Table, anchors: pa.Table, limit: int) -> pa.Table:
    names, found = ["anchor_no", "score", "id", "no"], []
    if len(rows) and len(anchors):
        block = _Block(anchors, rows)
        n = len(block.no)
        for i, keys, least, _ in block.keys(same_label=True):
            for key in keys[::-1][:limit].tolist():
                if key < 0:
                    break
                at = n - 1 - key % n
                found.append((int(block.anchor_no[i]), key // n + least, at, int(block.no[at])))
        return _found(found, block.id, names)
    return _found(found, rows.column("id").combine_chunks(), names)


def _best_other(rows: pa.Table, anchors: pa.Table, limit: int, low: int, high: int) -> pa.Table:
    names, found = ["anchor_no", "place", "score", "id", "no"], []
    if len(rows) and len(anchors):
        block = _Block(anchors, rows)
        n = len(block.no)
        wanted = anchors.column("positives").to_pylist()
        for i, keys, least, most in block.keys(same_label=False):
            for p in wanted[i]:
                # low * positive <= 100 * negative <= high * positive, in whole numbers
                least_wanted = max(-(-low * p["score"] // 100), least)
                most_wanted = min(high * p["score"] // 100, most)
                if least_wanted > most_wanted:
                    continue
                a = np.searchsorted(keys, (least_wanted - least) * n)
                b = np.searchsorted(keys, (most_wanted - least + 1) * n)
                for key in keys[max(a, b - limit) : b][::-1].tolist():
                    at = n - 1 - key % n
                    found.append((int(block.anchor_no[i]), p["place"], key // n + least, at, int(block.no[at])))
        return _found(found, block.id, names)
    return _found(found, rows.column("id").combine_chunks(), names)


def _dealt(df: DataFrame, own: str, of: int, other: str, others: int) -> DataFrame:
    """Rows with the number of their block, once for each block of the other side."""
    block = F.pmod(F.xxhash64("no"), F.lit(of)).cast("int").alias(own)
    return df.select("*", block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))


def mine(
    rows: DataFrame,
    anchor: Column,
    scale: float = 1.0,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has ``vec_id, label, embedding``; ``anchor`` says which rows are anchors; a component x counts as
    floor(scale * x). Higher scores come first, ties by smaller id.
    """
    spark = rows.sparkSession
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    path = scratch_path(spark, "vectors")
    flat = rows.select(F.col("vec_id").alias("id"), "label", F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").alias("vector"))
    schema = f"no long, id {kinds['vec_id']}, label {kinds['label']}, anchor boolean, dims int, vector binary"
    flat.mapInArrow(lambda it: _numbered(it, scale), schema).write.parquet(path)
    every = lambda: spark.read.schema(schema).parquet(path)
    anchors = lambda: every().filter("anchor").drop("anchor")
    n, m = every().agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    r, a = max(1, -(-n // ROWS)), max(1, -(-m // ANCHORS))
    key = ["row_block", "anchor_block"]
    left = _dealt(every().drop("anchor"), "row_block", r, "anchor_block", a).groupBy(key)
    right = _dealt(anchors(), "anchor_block", a, "row_block", r).groupBy(key)
    best = left.cogroup(right).applyInArrow(lambda x, y: _best_same(x, y, positives), f"anchor_no long, score long, id {kinds['vec_id']}, no long")
    order = Window.partitionBy("anchor_no").orderBy(F.desc("score"), "id", "no")
    best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    found_path = scratch_path(spark, "positives")
    best.write.parquet(found_path)
    best = spark.read.parquet(found_path)
    # at most ``positives`` entries each
    wanted = best.groupBy(F.col("anchor_no").alias("no")).agg(F.collect_list(F.struct("place", "score")).alias("positives"))
    right = _dealt(anchors().join(wanted, "no"), "anchor_block", a, "row_block", r).groupBy(key)
    hard = left.cogroup(right).applyInArrow(
        lambda x, y: _best_other(x, y, negatives, low, high), f"anchor_no long, place long, score long, id {kinds['vec_id']}, no long"
    )
    order = Window.partitionBy("anchor_no", "place").orderBy(F.desc("score"), "id", "no")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = best.select("anchor_no", F.col("place").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = anchors().select(F.col("no").alias("anchor_no"), F.col("id").alias("anchor_id"))
    out = hard.select("anchor_no", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(named, ["anchor_no", "place"]).join(ids, "anchor_no")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by 100; labels of ids divisible by 7 move on by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0, scale=256.0)


QUERIES = {"op12_hard_negatives": op12_hard_negatives}

ORACLES = {
    "op12_hard_negatives": """WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) QUALIFY row_number() OVER w <= 10""",
}
