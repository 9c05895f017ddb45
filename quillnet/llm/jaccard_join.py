"""Similarity join on word n-grams: MinHash banding, verified on full n-gram sets.

Rows with the same set of n-grams form a class.  Each class gets a signature;
bands of it are shuffled by their hashes, with as many bands as the target recall
needs.  Classes that bands connect form a cluster; a cluster is cut into blocks
of bounded bytes, and every pair of blocks is a task of its own.  There the pairs
of classes that share a band are verified on their full sets, so each of them is
verified once, however many bands it shares; a cluster of any size is worked on
in parallel, and no pair is ever a row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import concatenated, map_slices, materialise, quoted, row_key
from .repeats import POWERS2, Kind, Prefix, mix, symbols

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 5
#: Classes of a block, and bytes of their n-gram sets.
CROWD = 1024
BLOCK_BYTES = 4 << 20
_U = np.uint64


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands so that a pair at the threshold meets with the target probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_sets(buf: np.ndarray, offsets: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, concatenated, and the rows' offsets.  A text of fewer words is one n-gram."""
    codes, at = symbols(Kind(gram, gram, words=True), buf, offsets)
    size = np.diff(at)
    n = np.where(size >= gram, size - gram + 1, (size > 0).astype(np.int64))
    row = np.repeat(np.arange(len(size)), n)
    start = at[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    stop = np.minimum(start + gram, at[1:][row])
    h = np.empty(len(row), np.uint64)
    for a in range(0, len(row), 1 << 18):
        s, e = start[a : a + (1 << 18)], stop[a : a + (1 << 18)]
        h[a : a + (1 << 18)] = mix(Prefix(codes[s[0] : e[-1]]).of(s - s[0], e - s[0]) + (e - s).astype(np.uint64))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(size) + 1))


def signatures(grams: np.ndarray, offsets: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """Band hashes (texts x bands); a band's rows are minima of the grams under different permutations."""
    r = np.random.default_rng(seed)
    some = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros((len(offsets) - 1, bands), np.uint64)
    if not len(some):
        return out
    cuts = offsets[:-1][some]
    for b in range(bands):
        acc = np.full(len(some), b + 1, np.uint64)
        for _ in range(rows):
            a, x = (_U(v) for v in r.integers(1, 2**63, 2))
            v = (grams ^ x) * (a * _U(2) + _U(1))
            v ^= v >> _U(32)
            acc = mix(acc * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(v, cuts))
        out[some, b] = acc
    return out


def _profiles(docs: DataFrame, gram: int, bands: int, rows: int) -> DataFrame:
    """Per row: its keys, its class (128 bits of two hashes of its n-gram set; null without words), its number of n-grams, its bands."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, offsets = concatenated(batch.column("text"))
        grams, at = gram_sets(buf, offsets, gram)
        n = np.diff(at)
        sig = signatures(grams, at, bands, rows)
        one, two = Prefix(mix(grams)), Prefix(mix(grams, 0x9FB21C651E98DF25), POWERS2)
        both = np.stack([mix(one.of(at[:-1], at[1:]) + n.astype(np.uint64)), mix(two.of(at[:-1], at[1:]))], axis=1)
        items = pa.array([x.tobytes() if k else None for x, k in zip(both, n.tolist(), strict=True)], pa.binary())
        lists = pa.FixedSizeListArray.from_arrays(pa.array(sig.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "_qn_k0", "_qn_k1")), items, pa.array(n), lists], ["doc_id", "_qn_k0", "_qn_k1", "item", "n_grams", "bands"])

    return map_slices(docs, fn, "doc_id long, _qn_k0 long, _qn_k1 long, item binary, n_grams long, bands array<long>", limit=2 << 20)


def shared_grams(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of one block shares with each of another, by products of incidence matrices, a stretch of n-grams at a time."""
    ga, gb = np.concatenate(sets_a), np.concatenate(sets_b)
    ra, rb = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (sets_a, sets_b))
    both = np.intersect1d(ga, gb)
    shared = np.zeros((len(sets_a), len(sets_b)), np.float32)
    if not len(both):
        return shared
    ka, kb = np.searchsorted(both, ga), np.searchsorted(both, gb)
    ina, inb = (both[np.minimum(k, len(both) - 1)] == g for k, g in ((ka, ga), (kb, gb)))
    ra, ka, rb, kb = ra[ina], ka[ina], rb[inb], kb[inb]
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ra, ka, rb, kb = ra[oa], ka[oa], rb[ob], kb[ob]
    for start in range(0, len(both), 4096):
        i, j = np.searchsorted(ka, [start, start + 4096]), np.searchsorted(kb, [start, start + 4096])
        w = min(4096, len(both) - start)
        ma, mb = np.zeros((len(sets_a), w), np.float32), np.zeros((len(sets_b), w), np.float32)
        ma[ra[i[0] : i[1]], ka[i[0] : i[1]] - start] = 1
        mb[rb[j[0] : j[1]], kb[j[0] : j[1]] - start] = 1
        shared += ma @ mb.T
    return shared


def block_links(sets_a: list[np.ndarray], bands_a: np.ndarray, sets_b: list[np.ndarray], bands_b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) in two blocks of the pairs that share a band and whose sets reach the threshold; a before b in one and the same block."""
    meet = np.zeros((len(sets_a), len(sets_b)), bool)
    for a, b in zip(bands_a.T, bands_b.T, strict=True):
        meet |= a[:, None] == b[None, :]
    if same:
        meet = np.triu(meet, 1)
    x, y = np.nonzero(meet)
    na, nb = (np.array([len(s) for s in sets], float) for sets in (sets_a, sets_b))
    if len(x) <= 2 * (len(na) + len(nb)):
        shared = np.array([len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], float)
    else:
        shared = shared_grams(sets_a, sets_b)[x, y].astype(float)
    ok = shared >= threshold * (na[x] + nb[y] - shared) - 1e-6
    return x[ok], y[ok]


def _sets(docs: DataFrame, members: DataFrame, gram: int) -> DataFrame:
    """The members (keys of their row, cluster, parts, item, bands) with their n-gram sets as bytes."""
    last: list = [None]
    # merged by sorting, so that equal rows stand together: one of them is read
    joined = docs.join(members.hint("merge"), ["_qn_k0", "_qn_k1"]).select("_qn_k0", "_qn_k1", "cluster", "parts", "item", "bands", "text")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        items = batch.column("item").to_pylist()
        new = [k != before for k, before in zip(items, [last[0], *items], strict=False)]
        last[0] = items[-1]
        batch = batch.filter(pa.array(new))
        if not batch.num_rows:
            return None
        grams, at = gram_sets(*concatenated(batch.column("text")), gram)
        sets = [grams[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "parts", "item", "bands")), pa.array(sets, pa.binary())], ["cluster", "parts", "item", "bands", "grams"])

    return map_slices(joined, fn, "cluster long, parts int, item binary, bands array<long>, grams binary", limit=2 << 20)


def _links(sets: DataFrame, threshold: float) -> DataFrame:
    """item, root, n: for each pair of blocks, an item's number of links there and the least item that they connect it with."""
    blocks = sets.withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    # every member goes to the pairs (lower part, upper part) of its cluster that hold its own part
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("part")).alias("lo"), F.greatest(k, F.col("part")).alias("hi")))
    dealt = blocks.select("cluster", "item", "part", "bands", "grams", F.explode(meet).alias("pair")).select("cluster", "pair.lo", "pair.hi", "item", "part", "bands", "grams")

    def task(t: pa.Table) -> pa.Table:
        t = t.sort_by("item")
        items, part = t.column("item").to_pylist(), t.column("part").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
        bands = np.array(t.column("bands").to_pylist(), np.int64)
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        a, b = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        if not len(a) or not len(b):
            x = y = a[:0]
        else:
            x, y = block_links([sets[k] for k in a], bands[a], [sets[k] for k in b], bands[b], threshold, lo == hi)
            x, y = a[x], b[y]
        n = np.bincount(np.concatenate([x, y]), minlength=len(items))
        root = np.arange(len(items))
        while True:  # the least place that links connect a place with
            old = root.copy()
            np.minimum.at(root, x, root[y])
            np.minimum.at(root, y, root[x])
            root = root[root]
            if (root == old).all():
                break
        some = np.flatnonzero(n)
        return pa.table({"item": pa.array([items[k] for k in some], pa.binary()), "root": pa.array([items[k] for k in root[some]], pa.binary()), "n": pa.array(n[some], pa.int64())})

    return dealt.groupBy("cluster", "lo", "hi").applyInArrow(task, "item binary, root binary, n long")


def _joined(docs: DataFrame, threshold: float, gram: int, recall: float, rows: int) -> DataFrame:
    """The join's rows with their keys, and ``_qn_group``, a hash that stands for the group."""
    bands = bands_for(threshold, recall, rows)
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *row_key())
    table = materialise(_profiles(keyed, gram, bands, rows), "profiles")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_qn_k1")
    classes = table.where("item is not null").groupBy("item").agg(F.min("doc_id").alias("class_id"), F.min_by(F.struct("_qn_k0", "_qn_k1"), first).alias("key"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    # clusters are found over 64-bit numbers of classes; two classes of one number only share a cluster
    classes = materialise(classes.select("item", F.xxhash64("item").alias("node"), "class_id", "key.*", "n_grams", "bands"), "classes")
    hubs = classes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("hub"))
    met = materialise(hubs.groupBy("hub").agg(F.count("*").alias("c")).where("c > 1").select("hub"), "met")
    # nothing bounds these tables, so none is broadcast
    clusters = components(hubs.join(met.hint("merge"), "hub").select(F.col("node").alias("item"), "hub")).toDF("node", "cluster")
    members = materialise(clusters.join(classes.select("node", "item", "_qn_k0", "_qn_k1", "n_grams", "bands"), "node").drop("node"), "members")
    parts = F.greatest(F.ceil(F.count("*") / CROWD), F.ceil(F.sum("n_grams") * 8 / BLOCK_BYTES)).cast("int")
    sizes = materialise(members.groupBy("cluster").agg(parts.alias("parts")), "sizes")
    sets = _sets(keyed.select("_qn_k0", "_qn_k1", "text"), members.join(sizes, "cluster").drop("n_grams"), gram)
    links = materialise(_links(sets, threshold), "links")
    # groups: components of the links themselves
    groups = components(links.select("item", F.col("root").alias("hub"))).withColumnRenamed("component", "_qn_group")
    named = materialise(groups.join(classes.select("item", "class_id"), "item"), "named")
    ids = materialise(named.groupBy("_qn_group").agg(F.min("class_id").alias("group_id")), "groups")
    linked = named.select("item", "_qn_group").join(ids, "_qn_group").join(links.groupBy("item").agg(F.sum("n").alias("n_links")), "item")
    about = materialise(classes.select("item", "class_id").join(linked, "item", "left"), "about")
    own = F.concat(F.unhex(F.lpad(F.hex("_qn_k0"), 16, "0")), F.unhex(F.lpad(F.hex("_qn_k1"), 16, "0")), F.lit(b"-"))
    return table.select("doc_id", "_qn_k0", "_qn_k1", "item").join(about, "item", "left").select(
        "doc_id",
        "_qn_k0",
        "_qn_k1",
        F.coalesce("_qn_group", "item", own).alias("_qn_group"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("group_id", "class_id", "doc_id").alias("group_id"),
    )


def join(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, class_id, n_links, group_id.

    A class is the rows with the same set of word n-grams (words parted by ASCII
    white space, otherwise unchanged; a text of 1 to 4 words is one n-gram);
    class_id is its least doc_id.  n_links counts the other classes whose Jaccard
    similarity reaches the threshold; group_id is the least class that links
    connect it with.  A text without words, or null, is a class of its own without
    links.  Rows with null doc_id take part and count as links; they get class and
    group ids of other rows, null where there are none.  Texts of any length are
    read whole; repeated rows give repeated rows of one class; of equal ids either
    stands for the class; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    return _joined(docs, threshold, gram, recall, rows).drop("_qn_k0", "_qn_k1", "_qn_group")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """The input's columns, with one row of each group of ``join``: that of the least doc_id (null last).

    Texts without words and nulls stay, as groups of their own; of rows that repeat one stays.  An empty table stays empty.
    """
    found = _joined(docs, threshold, gram, recall, rows)
    stays = found.groupBy("_qn_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_qn_k1", "_qn_k0")).alias("one")).select("one._qn_k0", "one._qn_k1")
    keyed = docs.select("*", *row_key())
    return keyed.join(materialise(stays, "stays"), ["_qn_k0", "_qn_k1"], "left_semi").dropDuplicates(["_qn_k0", "_qn_k1"]).select(*quoted(docs.columns))
