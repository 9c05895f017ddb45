"""Repeated windows of symbols within and across documents: the engine of the two substring operators.

A window is W consecutive symbols of one row.  Winnowing picks in each window the
least k-gram by hash as its anchor, a function of the window's content alone, so
equal windows have equal anchors at equal offsets.  Consecutive windows with the
same anchor form a run; its content is what they span.  Runs are grouped by their
anchor's hash h:

* anchors that occur once hold no repeat and drop out by an aggregate and a join;
* of each group every different content goes to the operator's own solver (suffix
  sort, or seed and extend), with two of its occurrences if it has more than one;
  the solver compares the symbols themselves;
* what the solver finds in a content holds for all its occurrences.  Occurrences
  beyond the second are told by h and a keyless 64-bit BLAKE2 digest of the
  content, 128 bits in all;
* an anchor with more than ``CROWD`` different contents would not fit a task.
  Such a group is split by the content of each single window, told by a 128-bit
  BLAKE2 digest, and windows are counted; what repeats is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, concatenated, frugal, map_slices, materialise, texts_as_bytes, trim

#: Different contents of an anchor that a solver gets at once.
CROWD = 12_000
#: Bytes of a word up to which polynomials tell words apart.
POLYNOMIAL = 64
#: Symbols that are hashed at once, and bytes of contexts that a solver gets at once.
BLOCK = 1 << 18
SOLVE_BYTES = 4 << 20
SCAN_BYTES = 2 << 20
_BITS = 24

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15 | 1)
BASE2 = _U(0xD1B54A32D192ED03 | 1)
BYTE_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray, c: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(c)
    x ^= x >> _U(29)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


class Powers:
    """Powers of a base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, _U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up = np.concatenate([[_U(1)], np.cumprod(np.full(n, self.base))])
            self.down = np.concatenate([[_U(1)], np.cumprod(np.full(n, self.inv))])
        return self.up, self.down

    def forget(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)


POWERS, POWERS2 = Powers(BASE), Powers(BASE2)


class Prefix:
    """Prefix polynomial hashes of a sequence of 64-bit codes: the hash of any stretch in constant time."""

    def __init__(self, codes: np.ndarray, powers: Powers = POWERS):
        up, self.down = powers.to(len(codes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)])])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


@dataclass(frozen=True)
class Kind:
    """What is compared: W symbols a window, k a seed; words instead of bytes if set."""

    window: int
    seed: int
    words: bool = False

    @property
    def reach(self) -> int:
        """Most windows of a run."""
        return self.window - self.seed + 1


#: White space that parts words (0x20 and 0x09 to 0x0D).
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the rows begins and ends."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_codes(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit code of each word: two polynomials, mixed; words beyond POLYNOMIAL bytes get a digest, as long ones can be made to collide."""
    codes = np.empty(len(start), np.uint64)
    # in stretches, to keep the tables of powers small
    for a in range(0, len(start), BLOCK):
        s, e = start[a : a + BLOCK], stop[a : a + BLOCK]
        part = BYTE_CODES[buf[s[0] : e[-1]]]
        one, two = (Prefix(part, p).of(s - s[0], e - s[0]) for p in (POWERS, POWERS2))
        codes[a : a + BLOCK] = mix(one + (e - s).astype(np.uint64)) + mix(two, 0xFF51AFD7ED558CCD)
    for k in np.flatnonzero(stop - start > POLYNOMIAL).tolist():
        codes[k] = int.from_bytes(blake2b(buf[start[k] : stop[k]].tobytes(), digest_size=8).digest(), "little")
    return codes | _U(1)


def symbols(kind: Kind, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the rows' symbols, and the rows' offsets among them."""
    if not kind.words:
        return BYTE_CODES[buf], offsets
    start, stop = word_bounds(buf, offsets)
    return word_codes(buf, start, stop), np.searchsorted(start, offsets)


@dataclass
class Rows:
    """Rows of a batch: their bytes (words parted by one space), symbols, and where each symbol begins and ends."""

    buf: np.ndarray
    codes: np.ndarray
    at: np.ndarray
    start: np.ndarray | None
    stop: np.ndarray | None

    def content(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The bytes from each first symbol to each last one."""
        a, b = (first, last + 1) if self.start is None else (self.start[first], self.stop[last])
        data = self.buf.tobytes()
        return [data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def rows_of(kind: Kind, column: pa.Array) -> Rows:
    if not kind.words:
        buf, offsets = concatenated(column)
        return Rows(buf, BYTE_CODES[buf], offsets, None, None)
    texts = [b" ".join(t.split()) for t in texts_as_bytes(column)]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, stop = word_bounds(buf, offsets)
    return Rows(buf, word_codes(buf, start, stop), np.searchsorted(start, offsets), start, stop)


def digests(contents: list[bytes], size: int = 8) -> np.ndarray:
    """64-bit digests of contents, ``size // 8`` columns of them."""
    return np.frombuffer(b"".join([blake2b(c, digest_size=size).digest() for c in contents]), np.int64).reshape(len(contents), size // 8)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    out, size = x, 1
    while 2 * size <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == w else np.minimum(out[: len(x) - w + 1], out[w - size : w - size + len(x) - w + 1])


def runs(kind: Kind, codes: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of windows with the same anchor: row, first window, number of windows, anchor's offset, hash h of the anchor."""
    parts = []
    row = 0
    while row < len(offsets) - 1:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        if offsets[last] - offsets[row] <= 2 * BLOCK:
            parts.append(_runs(kind, codes[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row], row, 0))
        else:  # one long row, in overlapping pieces
            lo, hi = int(offsets[row]), int(offsets[row + 1])
            for a in range(lo, hi - kind.window + 1, BLOCK):
                piece = codes[a : min(hi, a + BLOCK + kind.window - 1)]
                parts.append(_runs(kind, piece, np.array([0, len(piece)]), row, a - lo))
        row = last
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in ("row", "s", "n", "d", "h")}


def _runs(kind: Kind, codes: np.ndarray, offsets: np.ndarray, row: int, shift: int) -> dict[str, np.ndarray]:
    w, k, n = kind.window, kind.seed, len(codes)
    empty = {x: np.zeros(0, np.int64) for x in ("row", "s", "n", "d", "h")}
    if n < w:
        return empty
    prefix = Prefix(codes)
    gram = mix((prefix.sums[k:] - prefix.sums[:-k]) * prefix.down[: n - k + 1])
    key = (gram >> _U(_BITS) << _U(_BITS)) | np.arange(n - k + 1, dtype=np.uint64)
    anchor = (sliding_min(key, kind.reach) & _U((1 << _BITS) - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.arange(n - w + 1)
    valid = owner[: n - w + 1] == owner[w - 1 :]
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    s = starts[first]
    if not len(s):
        return empty
    # a run ends before the next begins, and with its row's last window
    e = np.minimum(np.append(s[1:], n), offsets[owner[s] + 1] - w + 1)
    p = anchor[s]
    own = owner[s]
    return {"row": own + row, "s": s - offsets[own] + shift, "n": e - s, "d": p - s, "h": mix(gram[p], 0xC4CEB9FE1A85EC53).view(np.int64)}


KEYS = ["_qn_k0", "_qn_k1"]


def _run_table(docs: DataFrame, kind: Kind) -> DataFrame:
    """Runs of every row, with g, the digest of their content."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = rows_of(kind, batch.column("text"))
        r = runs(kind, rows.codes, rows.at)
        first = rows.at[r["row"]] + r["s"]
        g = digests(rows.content(first, first + r["n"] + (kind.window - 2))).ravel()
        row = pa.array(r["row"].astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(row) for c in KEYS), pa.array(r["h"], pa.int64()), pa.array(g, pa.int64()), pa.array(r["s"].astype(np.int32)), pa.array(r["n"].astype(np.int16)), pa.array(r["d"].astype(np.int16))],
            [*KEYS, "h", "g", "s", "n", "d"],
        )

    return map_slices(docs, fn, "_qn_k0 long, _qn_k1 long, h long, g long, s int, n short, d short", limit=SCAN_BYTES)


#: Gets the contents' bytes, number of windows, place of the anchor, and group; gives the stretches (content, first symbol, end) that repeat.
Solver = Callable[[Kind, list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _contexts(picked: DataFrame, docs: DataFrame, kind: Kind) -> DataFrame:
    """h, g, n, d and the content of each picked run (h, g, its row's keys, s, n, d)."""
    lists = picked.groupBy(*KEYS).agg(F.collect_list(F.struct("h", "g", "s", "n", "d")).alias("picked"))
    # merged by sorting, so that equal rows stand together: one of them is read
    joined = docs.join(lists.hint("merge"), KEYS).select(*KEYS, "text", "picked")
    last: list = [None]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys = list(zip(*(batch.column(c).to_pylist() for c in KEYS), strict=True))
        new = [k != before for k, before in zip(keys, [last[0], *keys], strict=False)]
        last[0] = keys[-1]
        batch = batch.filter(pa.array(new))
        if not batch.num_rows:
            return None
        rows = rows_of(kind, batch.column("text"))
        lists = batch.column("picked")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        flat = lists.flatten()
        n = flat.field("n").to_numpy().astype(np.int64)
        first = rows.at[row] + flat.field("s").to_numpy().astype(np.int64)
        contents = rows.content(first, first + n + (kind.window - 2))
        return pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("h", "g", "n", "d")), pa.array(contents, pa.binary())], ["h", "g", "n", "d", "ctx"])

    return map_slices(joined, fn, "h long, g long, n short, d short, ctx binary", limit=SCAN_BYTES)


def _spans(h: np.ndarray, g: np.ndarray, who: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Stretches (a, b) of contents, merged for each content (h, g)."""
    order = np.lexsort((a, g[who], h[who]))
    who, a, b = who[order], a[order], b[order]
    same = (h[who][1:] == h[who][:-1]) & (g[who][1:] == g[who][:-1]) if len(who) else np.zeros(0, bool)
    # contents are laid side by side, far enough apart, so that one pass merges all
    number = np.concatenate([[0], np.cumsum(~same)]) if len(who) else who
    far = number * (1 << 20)
    x, y = union_of(a + far, b + far)
    k = x >> 20
    at = np.searchsorted(number, k)
    return pa.RecordBatch.from_arrays([pa.array(h[who][at], pa.int64()), pa.array(g[who][at], pa.int64()), pa.array((x & 0xFFFFF).astype(np.int32)), pa.array((y - (k << 20)).astype(np.int32))], ["h", "g", "a", "b"])


def _solved(contexts: DataFrame, kind: Kind, solver: Solver) -> DataFrame:
    """Stretches (h, g, a, b) of contents that repeat, by the solver; whole groups at a time, about SOLVE_BYTES of them."""

    def solve(batch: pa.Table) -> pa.RecordBatch:
        h, g = batch.column("h").to_numpy(), batch.column("g").to_numpy()
        _, group = np.unique(h, return_inverse=True)
        n, d = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "d"))
        return _spans(h, g, *solver(kind, batch.column("ctx").to_pylist(), n, d, group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > SOLVE_BYTES:
                every = pa.Table.from_batches(held)
                h = every.column("h").to_numpy()
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0  # the last group may go on
                if cut:
                    yield solve(every.slice(0, cut))
                held = every.slice(cut).to_batches()
                size = sum(b.nbytes for b in held) if cut else 0
        if held:
            yield solve(pa.Table.from_batches(held))
        held = []
        POWERS.forget()
        trim()

    bounded_batches(contexts.sparkSession)
    return contexts.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, g long, a int, b int")


def _by_window(contexts: DataFrame, kind: Kind) -> DataFrame:
    """Stretches (h, g, a, b) of the contents of crowded anchors: every window is told by its digest, and those of two or more occurrences kept.

    A content occurs ``c`` times; each of its windows counts as often.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = rows_of(kind, batch.column("ctx"))
        n = batch.column("n").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        first = rows.at[:-1][row] + step
        xy = digests(rows.content(first, first + kind.window - 1), 16)
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("h", "g", "c")), pa.array(step.astype(np.int32)), pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], ["h", "g", "c", "a", "x", "y"])

    windows = map_slices(contexts.select("h", "g", "c", "n", "ctx"), fn, "h long, g long, c long, a int, x long, y long", column="ctx", limit=1 << 18)
    windows = materialise(windows, "windows")
    twice = materialise(windows.groupBy("x", "y").agg(F.sum("c").alias("c")).where("c > 1").select("x", "y"), "twice")
    return windows.join(twice, ["x", "y"]).select("h", "g", "a", (F.col("a") + kind.window).alias("b"))


def repeated(docs: DataFrame, kind: Kind, solver: Solver) -> DataFrame:
    """For rows (_qn_k0, _qn_k1, text): the row's keys and ``_qn_covered``, an array of stretches (a, b) of symbols whose
    union is what repeated windows cover.  Rows without any are absent.  Equal keys are repeated rows."""
    table = materialise(_run_table(docs, kind), "runs")
    # tables on both sides let the engine split a partition that one hot anchor or content fills
    often = materialise(table.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "often")
    hot = materialise(table.join(often, "h"), "anchors")
    one = F.struct(*KEYS, "s", "n", "d")
    kinds = materialise(hot.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(one).alias("one"), F.max(one).alias("two")), "kinds")
    crowded = materialise(kinds.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > CROWD).select("h"), "crowded")
    few, many = kinds, None
    if crowded.limit(1).count():
        few, many = kinds.join(crowded, "h", "left_anti"), kinds.join(crowded, "h", "left_semi")
    # a single occurrence's first and last are the same run; a row that repeats gives the same run twice
    pairs = few.select("h", "g", F.explode(F.when(F.col("c") > 1, F.array("one", "two")).otherwise(F.array("one"))).alias("o"))
    found = _solved(_contexts(pairs.select("h", "g", "o.*"), docs, kind), kind, solver)
    if many is not None:
        contexts = _contexts(many.select("h", "g", "one.*"), docs, kind).join(many.select("h", "g", "c"), ["h", "g"])
        found = found.unionByName(_by_window(contexts, kind))
    found = materialise(found, "found")
    every = hot.join(found, ["h", "g"]).select(*KEYS, (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b"))
    # a set: rows that repeat bring the same stretches
    return every.groupBy(*KEYS).agg(F.collect_set(F.struct("a", "b")).alias("_qn_covered"))


def union_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of a union of stretches; those that touch are one."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    first = np.concatenate([[True], a[1:] > b[:-1]])
    return a[first], b[np.append(np.flatnonzero(first)[1:] - 1, len(b) - 1)]


def distinct_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(x << 32 | y)
    return both >> 32, both & 0xFFFFFFFF
