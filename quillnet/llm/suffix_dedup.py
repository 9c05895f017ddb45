"""Exact substring removal by a hash-compared suffix sort.

Within a group of runs that share an anchor, the suffixes at the anchors are
sorted by mergesort.  Two suffixes are compared by finding their longest common
extension by binary search over prefix polynomial hashes and looking at the next
byte.  Windows that begin before the anchor are put in order by prepending one
byte at a time, a stable counting pass on the order before.  Equal windows then
stand next to each other; matches by hash are verified byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, others, quoted, row_key, texts_as_bytes, widened
from .repeats import BYTE_CODES, Kind, Prefix, repeated, union_of

BYTES = Kind(window=200, seed=32)


def common_extension(prefix: Prefix, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How far the stretches at a and b agree, up to ``most``: binary search over prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), most.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = prefix.of(a, a + mid) == prefix.of(b, b + mid)
        lo = np.where(open_ & same, mid, lo)
        hi = np.where(open_ & ~same, mid - 1, hi)
    return lo


def suffix_sort(buf: np.ndarray, prefix: Prefix, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes at ``at``, of ``size`` bytes, within their groups: bottom-up mergesort, all merges of a level at once."""
    order = np.argsort(group, kind="stable")
    if not len(order):
        return order
    begin = np.flatnonzero(np.diff(group[order], prepend=group[order[0]] - 1))
    count = np.diff(np.append(begin, len(order)))
    base, total = np.repeat(begin, count), np.repeat(count, count)
    place = np.arange(len(order)) - base

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix y stands before suffix x; equal ones if ``ties``."""
        most = np.minimum(size[x], size[y])
        n = common_extension(prefix, at[x], at[y], most)
        end = n == most
        last = len(buf) - 1
        by, bx = buf[np.minimum(at[y] + n, last)].astype(np.int64), buf[np.minimum(at[x] + n, last)].astype(np.int64)
        return np.where(end, (size[y] < size[x]) | ((size[y] == size[x]) & ties), by < bx)

    width = 1
    while width < count.max():
        live = np.flatnonzero(total > width)
        pos, b, t = place[live], base[live], total[live]
        left = (pos // width) % 2 == 0
        start = np.where(left, pos // width * width + width, pos // width * width - width)  # of the run to merge with
        stop = np.minimum(start + width, t)
        lo, hi = np.minimum(start, t), np.maximum(stop, np.minimum(start, t))
        first = lo.copy()
        x = order[live]
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            k = np.flatnonzero(open_)
            ahead = before(x[k], order[b[k] + mid[k]], ~left[k])
            lo[k] = np.where(ahead, mid[k] + 1, lo[k])
            hi[k] = np.where(ahead, hi[k], mid[k])
        target = pos // (2 * width) * 2 * width + pos % width + (lo - first)
        new = order.copy()
        new[b + target] = x
        order = new
        width *= 2
    return order


def by_suffixes(kind: Kind, contents: list[bytes], n: np.ndarray, d: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (content, first byte, end) that occur in another place of the contents given."""
    w = kind.window
    buf = np.frombuffer(b"".join(contents), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in contents])]).astype(np.int64)
    prefix = Prefix(BYTE_CODES[buf])
    anchor = offsets[:-1] + d
    order = suffix_sort(buf, prefix, anchor, np.minimum(offsets[1:] - anchor, w), group)
    # neighbours whose windows agree by hash, from one number of bytes before the anchor to another
    after, since = np.full(len(contents), -1), np.zeros(len(contents), np.int64)
    chains: list[tuple[np.ndarray, ...]] = []
    for back in range(kind.reach + 1):
        if back:
            order = order[d[order] >= back]
            order = order[np.argsort(buf[anchor[order] - back], kind="stable")]
        # windows that begin ``back`` bytes before their anchor
        row = order[d[order] - back < n[order]] if back < kind.reach else order[:0]
        now = np.full(len(contents), -1)
        if len(row) > 1:
            start = anchor[row] - back
            h = prefix.of(start, start + w)
            same = (h[1:] == h[:-1]) & (group[row[1:]] == group[row[:-1]])
            now[row[:-1][same]] = row[1:][same]
        changed = now != after
        ended = np.flatnonzero(changed & (after >= 0))
        chains.append((ended, after[ended], since[ended], np.full(len(ended), back - 1)))
        since[changed] = back
        after = now
    x, y, least, most = (np.concatenate(c) for c in zip(*chains, strict=True))
    ok = _equal(buf, anchor[x] - most, anchor[y] - most, most - least + w)
    if not ok.all():  # hashes misled: these windows one by one
        bad = np.flatnonzero(~ok)
        count = most[bad] - least[bad] + 1
        each = np.repeat(bad, count)
        back = np.repeat(least[bad], count) + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        x, y, least, most = (np.concatenate([v[ok], v[each] if u is None else u]) for v, u in ((x, None), (y, None), (least, back), (most, back)))
        keep = np.append(np.ones(int(ok.sum()), bool), _equal(buf, anchor[x[ok.sum() :]] - back, anchor[y[ok.sum() :]] - back, np.full(len(back), w)))
        x, y, least, most = x[keep], y[keep], least[keep], most[keep]
    who = np.concatenate([x, y])
    return who, d[who] - np.tile(most, 2), d[who] - np.tile(least, 2) + w


def _equal(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether stretches of ``size`` bytes, eight at least, agree: the bytes themselves, in words of eight."""
    ok = np.ones(len(a), bool)
    words = np.lib.stride_tricks.as_strided(buf.view(np.uint8), (max(len(buf) - 7, 0), 8), (1, 1))
    live = np.arange(len(a))
    k = 0
    while len(live):
        at = np.minimum(k, size[live] - 8)
        ok[live] = (words[a[live] + at] == words[b[live] + at]).all(axis=1)
        k += 8
        live = live[ok[live] & (size[live] > k)]
    return ok


def _cut(text: bytes, a: np.ndarray, b: np.ndarray) -> bytes:
    parts, at = [], 0
    for s, e in zip(a.tolist(), b.tolist(), strict=True):
        parts.append(text[at:s])
        at = e
    parts.append(text[at:])
    return b"".join(parts)


def remove_repeats(docs: DataFrame, kind: Kind = BYTES) -> DataFrame:
    """The input's rows and columns, with n_bytes, n_removed, n_spans and kept (bytes) in place of columns of these names.

    Removed is every byte that a repeated window covers.  A null or empty text
    keeps nothing; texts of any length are read whole; rows that repeat, or whose
    doc_id is null, count as occurrences of their own, so each of two equal long
    texts goes; no occurrence is preferred, so there are no ties.  Cuts may fall
    inside a character.  An empty table gives no rows.  Other columns stay as they
    are, whatever their names.
    """
    rest = others(docs, "n_bytes", "n_removed", "n_spans", "kept")
    keyed = docs.select(*quoted(rest), *row_key())
    covered = repeated(keyed.select("_qn_k0", "_qn_k1", "text"), kind, by_suffixes)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        buf = texts_as_bytes(batch.column("text"))
        kept, removed, spans = [], [], []
        for text, c in zip(buf, batch.column("_qn_covered"), strict=True):
            if c.is_valid:
                a, b = union_of(*(c.values.field(x).to_numpy().astype(np.int64) for x in ("a", "b")))
                kept.append(_cut(text, a, b))
                spans.append(len(a))
            else:
                kept.append(text)
                spans.append(0)
            removed.append(len(text) - len(kept[-1]))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([len(t) for t in buf], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], [*rest, "n_bytes", "n_removed", "n_spans", "kept"])

    wide = keyed.join(covered, ["_qn_k0", "_qn_k1"], "left").select(*quoted(rest), "_qn_covered")
    return map_slices(wide, fn, widened(docs, rest, "n_bytes long, n_removed long, n_spans long, kept binary"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
