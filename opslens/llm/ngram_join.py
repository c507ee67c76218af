"""Exact Jaccard self-join of word-shingle sets through a prefix tree.

Shingles have one global order, from frequent to rare: a bounded table of the most frequent ones
(``ORDER_SIZE`` entries, counted over all documents) and, beyond it, the hash. The order is the same
everywhere, so any table gives right results; a good one gives short candidate lists. Shingles that the
table lacks and more than ``CROWD`` sets would look at are counted and put in below it: how many shingles
recur grows with the corpus, and groups of such shingles tie unrelated texts together.

1. Equal sets become one class (set hashes), so copies are never compared; only texts that may stand for
   a class by a filter of ids (``keyset``) go on.
2. Two sets with the wanted overlap share one of their rarest shingles (for a Jaccard of 4/5, one of
   the last ``n // 5 + 1`` in the order). Spark groups classes by those shingles; only shingles that
   two classes hold go on.
3. Groups of at most ``SMALL`` classes give candidate pairs with the number of rare shingles they share;
   a pair that misses more of them than a linked pair can miss is dropped. Larger groups tie their
   classes to one pivot. What hangs together by either is a cluster, dealt to blocks of about ``BLOCK``
   classes; two blocks of a cluster meet in one task if a candidate pair or a large group stands in
   both. So near copies travel once per block, and no large group is expanded into pairs.
4. Inside a task the candidates of a probe are walked through a prefix tree of the block's ordered
   sets: sets with the same beginning share that part's overlap, and a subtree ends where the overlap
   so far plus the remaining length cannot reach the bound. Candidates that earlier links already
   connect with the probe are passed over, so groups of near copies cost little more than their size.

Defined results: null, empty and blank texts have the empty set and are linked with nothing; fewer
words than a shingle give one shingle of all words; repeated texts are one class; ids must be unique;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from opslens.llm.components import components, smallest_member
from opslens.llm.keyset import divided
from opslens.llm.sampling import first_by_hash
from opslens.llm.textnum import Spans, chunks, mix, signed, split_words
from opslens.session import scratch_path

U64 = np.uint64
SHINGLE = 5
SHARE = (4, 5)  # Jaccard bound as a fraction
ORDER_SIZE = 131_072  # shingles in the broadcast order: 16 bytes each
LAST = -1  # the salt of rows that tell how far a set was looked at
SALTS = 64  # a frequent shingle's group is dealt to so many tasks
BLOCK = 256  # sets in a block, on average
SMALL = 32  # groups up to this size are listed as pairs
CROWD = 12  # sets that look at a shingle beyond the order before it is put in
CROWDED = 524_288  # such shingles at most, the most crowded ones


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their offsets."""
    words = split_words(column, lower=True)
    counts = words.counts
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    owner = np.repeat(np.arange(len(counts)), sizes)
    start = np.arange(first[-1]) - first[owner] + words.first[owner]
    hashes = Spans(words.hashes())(start, start + np.minimum(k, counts[owner]))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    offsets = np.zeros(len(first), np.int64)
    np.cumsum(np.bincount(owner[new], minlength=len(counts)), out=offsets[1:])
    return hashes[new], offsets


def _set_keys(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free hashes of each set."""
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.zeros(len(hashes) + 1, U64)
        np.cumsum(mix(hashes ^ U64(seed)), out=sums[1:])
        out.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(U64)))
    return out[0], out[1]


class Order:
    """Place of each shingle in the global order; 0 beyond the table, rising with frequency."""

    def __init__(self, shingles: np.ndarray, rank: np.ndarray):
        by = np.argsort(shingles)
        self.shingles, self.rank = shingles[by], rank[by]

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.shingles, hashes), len(self.shingles) - 1)
        return np.where(self.shingles[at] == hashes, self.rank[at], 0)


def _scan(batches: Iterator[pa.RecordBatch], k: int, least: int = 2) -> Iterator[pa.RecordBatch]:
    """Size and hashes of each text's set; and rows with the shingles that several documents of one batch hold, with the number of those."""
    held: list[np.ndarray] = []
    names = ["doc_id", "n", "set_id", "set2", "shingle"]

    def counted(kind: pa.DataType) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        often = n >= least
        none = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none.cast(kind), pa.array(n[often]), none, none, signed(values[often])], names)

    size = 0
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for part in chunks(batch):
            hashes, offsets = shingle_sets(part.column("text"), k)
            one, two = _set_keys(hashes, offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), signed(one), signed(two), pa.nulls(len(part), pa.int64())], names)
            held.append(hashes)
            size += len(hashes)
            if size > 2_000_000:
                yield counted(kind)
                size = 0
    if held:
        yield counted(kind)


def frequency_order(counts: DataFrame, size: int = ORDER_SIZE) -> Order:
    """The ``size`` most frequent shingles, by documents per batch that hold them, over all documents; ``counts`` is (shingle, n)."""
    top = most_frequent(_saved(counts.groupBy("shingle").agg(F.sum("n").alias("n")), "shingle-counts"), size)
    return Order(top["shingle"].to_numpy(np.int64).view(U64), np.arange(len(top), 0, -1))


def most_frequent(counts: DataFrame, size: int) -> pd.DataFrame:
    """The ``size`` rows of (shingle, n) with the greatest counts, from the greatest on."""
    # the count that the last of them has; different counts are few, at most the root of twice their sum
    have, least = 0, 0
    for n, shingles in sorted(((r["n"], r["count"]) for r in counts.groupBy("n").count().collect()), reverse=True):
        least, have = n, have + shingles
        if have >= size:
            break
    # ties at that count go by the shingle, which is a hash: first_by_hash takes as many as are still wanted
    more, tied = counts.filter(F.col("n") > least), counts.filter(F.col("n") == least)
    wanted = size - more.count()
    return more.unionByName(first_by_hash(tied, F.col("shingle"), wanted)).orderBy(F.desc("n"), "shingle").toPandas()


def _crowded(batches: Iterator[pa.RecordBatch], k: int, order: Order, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The looked-at shingles of each set that the order has no rank for."""
    for batch in batches:
        for part in chunks(batch):
            hashes, offsets = shingle_sets(part.column("text"), k)
            owner, rank, place = _rarest_first(hashes, offsets, order)
            yield pa.RecordBatch.from_arrays([signed(hashes[(rank == 0) & (place < _n_rarest(np.diff(offsets), share)[owner])])], ["shingle"])


def refined(texts: DataFrame, order: Order, k: int = SHINGLE, share: tuple[int, int] = SHARE, size: int = CROWDED) -> Order:
    """The order with the shingles put in, below all others, that more than ``CROWD`` sets look at and that it has no rank for.

    How many shingles that many texts hold grows with the corpus, the first table does not. ``texts`` has each set once.
    """
    looked = texts.mapInArrow(lambda it: _crowded(it, k, order, share), "shingle long").repartition("shingle")
    top = most_frequent(_saved(looked.groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD), "crowded"), size)
    more = top["shingle"].to_numpy(np.int64).view(U64)
    return Order(np.append(more, order.shingles), np.append(np.arange(len(more), 0, -1), order.rank + len(more)))


def _rarest_first(hashes: np.ndarray, offsets: np.ndarray, order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, rank and place in the order, from the rarest on, of each hash."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    rank = order(hashes)
    place = np.zeros(len(hashes), np.int64)
    common, rare = np.flatnonzero(rank > 0), np.flatnonzero(rank == 0)
    n_rare = np.bincount(owner[rare], minlength=len(n))
    place[rare] = np.arange(len(rare)) - (np.cumsum(n_rare) - n_rare)[owner[rare]]
    common = common[np.lexsort((rank[common], owner[common]))]
    n_common = n - n_rare
    place[common] = np.arange(len(common)) - (np.cumsum(n_common) - n_common)[owner[common]] + n_rare[owner[common]]
    return owner, rank, place


def _n_rarest(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """How many of its rarest shingles a set of ``n`` has to look at."""
    return n - -(-n * share[0] // share[1]) + 1


def _rarest(batches: Iterator[pa.RecordBatch], k: int, order: Order, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Each set's rarest shingles, of which linked sets share at least one; and, with the salt ``LAST``, the last of these in the order."""
    for batch in batches:
        for part in chunks(batch):
            hashes, offsets = shingle_sets(part.column("text"), k)
            owner, rank, place = _rarest_first(hashes, offsets, order)
            n_rarest = _n_rarest(np.diff(offsets), share)[owner]
            keep, last = np.flatnonzero(place < n_rarest), np.flatnonzero(place == n_rarest - 1)
            sets = _set_keys(hashes, offsets)[0]
            # a frequent shingle's members are dealt out by set, all others stay together
            salt = np.where(rank[keep] > 0, (sets[owner[keep]] >> U64(32)).astype(np.int64) % SALTS, 0)
            # flipping the sign bit keeps the order of unsigned values
            columns = [np.append(hashes[keep], hashes[last] ^ U64(1 << 63)), np.append(salt, np.full(len(last), LAST)), np.append(rank[keep], rank[last]), sets[owner[np.append(keep, last)]]]
            yield pa.RecordBatch.from_arrays([signed(columns[0]), pa.array(columns[1].astype(np.int8)), pa.array(columns[2].astype(np.int32)), signed(columns[3])], ["shingle", "salt", "rank", "set_id"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (shingle, set_id), those whose shingle is frequent or held by two sets, no row twice; and the
    last looked-at shingles, with their rank."""
    held = None
    for batch in batches:
        shingle, ids, rank, salt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shingle", "set_id", "rank", "salt"))
        if (ends := salt == LAST).any():
            yield pa.RecordBatch.from_arrays([pa.array(shingle[ends]), pa.array(ids[ends]), pa.array(rank[ends])], ["shingle", "set_id", "last"])
        now = [shingle[~ends], ids[~ends], rank[~ends] > 0, np.zeros(int((~ends).sum()), bool)]
        if held is not None:
            now = [np.concatenate(pair) for pair in zip(held, now)]
        if not len(now[0]):
            continue
        fresh = np.ones(len(now[0]), bool)
        fresh[1:] = (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])
        shingle, ids, frequent, given = (x[fresh] for x in now)
        same = shingle[1:] == shingle[:-1]
        keep = frequent.copy()
        keep[1:] |= same
        keep[:-1] |= same
        out = keep & ~given
        yield pa.RecordBatch.from_arrays([pa.array(shingle[out]), pa.array(ids[out]), pa.nulls(int(out.sum()), pa.int32())], ["shingle", "set_id", "last"])
        # whether the last row has company shows with the next batch
        held = [shingle[-1:], ids[-1:], frequent[-1:], keep[-1:]]


class PrefixTree:
    """Sets in the global order, sorted, so that each one repeats the beginning it shares with the one before."""

    def __init__(self, ordered: list[np.ndarray]):
        self.by = sorted(range(len(ordered)), key=lambda i: ordered[i].astype(">u8").tobytes())
        self.place = np.empty(len(ordered), np.int64)
        self.place[self.by] = np.arange(len(ordered))
        self.paths = [ordered[i] for i in self.by]
        self.shared = [0]
        for one, two in zip(self.paths, self.paths[1:]):
            n = min(len(one), len(two))
            differ = one[:n] != two[:n]
            self.shared.append(int(differ.argmax()) if differ.any() else n)
        self.shared_array = np.array(self.shared)

    def reaching(self, probe: np.ndarray, wanted: np.ndarray, need: np.ndarray) -> Iterator[int]:
        """Those of the sets ``wanted`` that have at least ``need`` elements of ``probe``, which is sorted by value."""
        done = np.zeros(1, np.int64)  # overlap at each depth of the current path
        last = -1
        order = np.argsort(self.place[wanted])
        for i, least in zip(wanted[order].tolist(), need[order].tolist()):
            at = int(self.place[i])
            path = self.paths[at]
            depth = min(int(self.shared_array[last + 1 : at + 1].min()) if last >= 0 else 0, len(done) - 1)
            last, done = at, done[: depth + 1]
            if done[-1] + min(len(path) - depth, len(probe) - done[-1]) < least:
                continue  # a longer common beginning of the next set ends here as well
            rest = path[depth:]
            found = np.minimum(np.searchsorted(probe, rest), len(probe) - 1)
            done = np.concatenate([done, done[-1] + np.cumsum(probe[found] == rest)])
            if done[-1] >= least:
                yield i


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        packed = [pa.compress(t, codec="zstd", asbytes=True) for t in raw]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "size", "packed"])


def _unpack(packed: list[bytes], sizes: list[int]) -> pa.Array:
    return pa.array([pa.decompress(p, decompressed_size=n, codec="zstd", asbytes=True).decode() if n else "" for p, n in zip(packed, sizes)], pa.large_string())


def _block_links(ids: list, sides: np.ndarray, texts: pa.Array, k: int, order: Order, share: tuple[int, int]) -> Iterator[tuple]:
    """Links between the two sides of a block pair (side 2 stands on both); links within what is connected are left out."""
    num, den = share
    hashes, offsets = _sets_in_parts(texts, k)
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    rank = order(hashes)
    by = np.lexsort((hashes, -rank, owner))
    ordered = [hashes[by[a:b]] for a, b in zip(offsets[:-1], offsets[1:])]
    # candidates share one of the rarest shingles
    rare = _n_rarest(n, share)
    tail = [o[len(o) - r :] for o, r in zip(ordered, rare.tolist())]
    keys, key = np.unique(np.concatenate(tail), return_inverse=True)
    holder = np.repeat(np.arange(len(n)), rare)
    inverse = np.argsort(key, kind="stable")
    start = np.append(0, np.cumsum(np.bincount(key, minlength=len(keys))))
    mine = np.append(0, np.cumsum(rare))
    tree = PrefixTree(ordered)
    root = np.arange(len(n))
    for p in np.flatnonzero(sides != 1).tolist():
        own = key[mine[p] : mine[p + 1]]
        partners = np.unique(np.concatenate([holder[inverse[start[t] : start[t + 1]]] for t in own.tolist()]))
        partners = partners[(sides[partners] == 1) | ((sides[partners] == 2) & (partners > p))]
        partners = partners[(n[partners] * den >= n[p] * num) & (n[p] * den >= n[partners] * num) & (root[partners] != root[p])]
        probe = np.sort(ordered[p])
        need = -(-num * (len(probe) + n[partners]) // (num + den))
        while len(partners):
            # one partner of every component first; after a link the rest of that component needs no look
            _, first = np.unique(root[partners], return_index=True)
            for i in list(tree.reaching(probe, partners[first], need[first])):
                yield ids[p], ids[i]
                root[root == root[i]] = root[p]
            left = np.ones(len(partners), bool)
            left[first] = False
            left &= root[partners] != root[p]
            partners, need = partners[left], need[left]
            if len(first) * 4 > len(partners):
                for i in tree.reaching(probe, partners, need):
                    if root[i] != root[p]:
                        yield ids[p], ids[i]
                        root[root == root[i]] = root[p]
                break


def _sets_in_parts(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of a long column in pieces of bounded size."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = [shingle_sets(part.column("text"), k) for part in chunks(batch)]
    return np.concatenate([p[0] for p in parts]), np.append(0, np.cumsum(np.concatenate([np.diff(p[1]) for p in parts])))


def _links(batches: Iterator[pa.RecordBatch], k: int, order: Order, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links of every block pair, from rows sorted by block pair; a block pair is at most two blocks."""
    pair, rows = None, []

    def linked() -> pa.RecordBatch:
        ids = [r[0] for r in rows]
        got = list(_block_links(ids, np.array([r[1] for r in rows]), _unpack([r[3] for r in rows], [r[2] for r in rows]), k, order, share))
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], kind) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        columns = [batch.column(c).to_pylist() for c in ("x", "y", "doc_id", "side", "size", "packed")]
        for x, y, *row in zip(*columns):
            if (x, y) != pair:
                if len(rows) > 1:
                    yield linked()
                pair, rows = (x, y), []
            rows.append(row)
    if len(rows) > 1:
        yield linked()


def _saved(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, share: tuple[int, int] = SHARE, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id reachable over links of Jaccard >= share."""
    texts = docs.select("doc_id", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    scanned = _saved(texts.mapInArrow(lambda it: _scan(it, k), f"doc_id {kind}, n long, set_id long, set2 long, shingle long"), "sets")
    keys = scanned.filter("shingle IS NULL").drop("shingle")
    same = ["n", "set_id", "set2"]
    full = _saved(keys.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")

    ones = divided(texts, full.select(F.col("rep").alias("doc_id")), ["doc_id"])[0]
    order = refined(ones, frequency_order(scanned.filter("shingle IS NOT NULL").select("shingle", "n")), k, share)
    posted = ones.mapInArrow(lambda it: _rarest(it, k, order, share), "shingle long, salt byte, rank int, set_id long")
    sorted_rows = posted.repartition("shingle", "salt").sortWithinPartitions("shingle", "set_id")
    told = _saved(sorted_rows.mapInArrow(_shared, "shingle long, set_id long, last int"), "groups")
    groups = told.filter("last IS NULL").select("shingle", "set_id")
    ends = told.filter("last IS NOT NULL").select("set_id", F.struct(F.col("last").alias("rank"), "shingle").alias("last")).distinct()

    sized = groups.groupBy("shingle").agg(F.count("*").alias("members"), F.min("set_id").alias("pivot")).filter("members > 1")
    few = groups.join(sized.filter(F.col("members") <= SMALL).select("shingle"), "shingle")
    many = _saved(groups.join(sized.filter(F.col("members") > SMALL).select("shingle", "pivot"), "shingle"), "large")
    pairs = few.toDF("shingle", "x").join(few.toDF("shingle", "y"), "shingle").filter("x < y").groupBy("x", "y").agg(F.count("*").alias("common"))
    info = full.select("set_id", "n").join(ends, "set_id")
    counted = pairs.join(info.toDF("x", "nx", "lx"), "x").join(info.toDF("y", "ny", "ly"), "y")
    num, den = share
    # both have looked at all their shingles up to the earlier of the two ends
    n_first = F.when(F.col("lx") <= F.col("ly"), F.col("nx")).otherwise(F.col("ny"))
    looked = n_first - F.ceil(n_first * num / den) + 1
    overlap = F.ceil((F.col("nx") + F.col("ny")) * num / (num + den))
    fits = (F.col("nx") * den >= F.col("ny") * num) & (F.col("ny") * den >= F.col("nx") * num)
    close = _saved(counted.filter(fits & (looked - F.col("common") <= n_first - overlap)).select("x", "y"), "close")

    ties = close.unionByName(many.filter("set_id <> pivot").select(F.col("set_id").alias("x"), F.col("pivot").alias("y")))
    clusters = components(ties, "x", "y").toDF("set_id", "root")
    sizes = clusters.groupBy("root").agg(F.ceil(F.count("*") / block).alias("blocks"))
    part = F.pmod(F.xxhash64("set_id"), F.col("blocks"))
    placed = _saved(clusters.join(sizes, "root").select("set_id", F.xxhash64("root", part).alias("block")), "blocks")

    by_pair = close.join(placed.toDF("x", "bx"), "x").join(placed.toDF("y", "by"), "y").select("bx", "by")
    stands = many.join(placed, "set_id").select("shingle", "block").distinct()
    by_group = stands.toDF("shingle", "bx").join(stands.toDF("shingle", "by"), "shingle").select("bx", "by")
    meet = by_pair.unionByName(by_group).select(F.least("bx", "by").alias("x"), F.greatest("bx", "by").alias("y")).distinct()
    meet = _saved(meet, "meetings")
    members = _saved(placed.join(full.select("set_id", F.col("rep").alias("doc_id")), "set_id").select("block", "doc_id"), "placed")
    packed = divided(texts, members.select("doc_id"), ["doc_id"])[0].mapInArrow(_pack_texts, f"doc_id {kind}, size long, packed binary")
    carried = _saved(members.join(packed, "doc_id"), "members")
    left = meet.join(carried.withColumnRenamed("block", "x"), "x").withColumn("side", F.when(F.col("x") == F.col("y"), 2).otherwise(0))
    right = meet.filter("x < y").join(carried.withColumnRenamed("block", "y"), "y").withColumn("side", F.lit(1))
    both = left.unionByName(right).select("x", "y", "doc_id", "side", "size", "packed")
    both = both.repartition("x", "y").sortWithinPartitions("x", "y", "doc_id")
    links = _saved(both.mapInArrow(lambda it: _links(it, k, order, share), f"a {kind}, b {kind}"), "links")

    members = smallest_member(components(links)).toDF("rep", "component_id")
    named = keys.join(full, same, "left").join(members, "rep", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep", "doc_id").alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_ngram_join": op4_ngram_join}

_SPACE = r"[\x20\x09-\x0D]+"
ORACLES = {
    "op4_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
n AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS s FROM n),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN size USING (doc_id)
"""
}
