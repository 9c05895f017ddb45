"""Repeated passages of words, by seed and extend.

Documents meet on winnowed anchors, seeds of a few words.  Within an anchor's
group occurrences are put in the order of what follows the seed; those that also
agree on the words before it, one by one, are joined with their neighbours in
that order, which match furthest.  Every joined pair is extended to the left and
to the right, word by word, until the words differ; the stretches that reach the
window's length are maximal repeats.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, others, quoted, row_key, texts_as_bytes, widened
from .repeats import Kind, distinct_pairs, repeated, union_of

WORDS = Kind(window=35, seed=8, words=True)


def numbered(contents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all contents as numbers, equal just for equal words, and the contents' offsets."""
    split = [c.split(b" ") for c in contents]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    every = list(chain.from_iterable(split))
    number = {w: k for k, w in enumerate(dict.fromkeys(every))}
    return np.fromiter(map(number.__getitem__, every), np.int64, len(every)), offsets


def neighbours(kind: Kind, words: np.ndarray, offsets: np.ndarray, d: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of contents to extend: at each number of equal words before the seed, neighbours in the order of what follows it."""
    seed, stop = offsets[:-1] + d, offsets[1:]
    after = seed[:, None] + np.arange(kind.window)
    follow = np.where(after < stop[:, None], words[np.minimum(after, len(words) - 1)], -1)
    order = np.lexsort((*follow.T[::-1], group))
    kin = group.astype(np.int64)  # which group, and which words before the seed
    pairs_x, pairs_y = [], []
    for left in range(kind.reach):
        if left:
            order = order[d[order] >= left]
            if len(order) < 2:
                break
            word = words[seed[order] - left]
            by = np.lexsort((word, kin[order]))  # stable: what follows keeps its order
            order, word = order[by], word[by]
            new = np.ones(len(order), bool)
            new[1:] = (kin[order][1:] != kin[order][:-1]) | (word[1:] != word[:-1])
            kin[order] = np.cumsum(new)
            alone = new & np.append(new[1:], True)
            order = order[~alone]
        same = kin[order][1:] == kin[order][:-1]
        pairs_x.append(order[:-1][same])
        pairs_y.append(order[1:][same])
    x, y = np.concatenate(pairs_x), np.concatenate(pairs_y)
    return distinct_pairs(np.minimum(x, y), np.maximum(x, y))


def by_extension(kind: Kind, contents: list[bytes], n: np.ndarray, d: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats (content, first word, end) of at least the window's length that hold the seed."""
    words, offsets = numbered(contents)
    x, y = neighbours(kind, words, offsets, d, group)
    seed, stop = offsets[:-1] + d, offsets[1:]
    left, right = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    while len(live):
        p, q = seed[x[live]] + right[live], seed[y[live]] + right[live]
        on = (p < stop[x[live]]) & (q < stop[y[live]])
        on[on] = words[p[on]] == words[q[on]]
        live = live[on]
        right[live] += 1
    live = np.arange(len(x))
    while len(live):
        live = live[(left[live] < d[x[live]]) & (left[live] < d[y[live]])]
        live = live[words[seed[x[live]] - left[live] - 1] == words[seed[y[live]] - left[live] - 1]]
        left[live] += 1
    long = np.flatnonzero(left + right >= kind.window)
    who = np.concatenate([x[long], y[long]])
    return who, d[who] - np.tile(left[long], 2), d[who] + np.tile(right[long], 2)


def remove_passages(docs: DataFrame, kind: Kind = WORDS) -> DataFrame:
    """The input's rows and columns, with n_words, n_removed and kept (words joined by a space) in place of columns of these names.

    Removed is every word that a repeated window covers.  A null or empty text has
    no words; texts of any length are read whole; rows that repeat, or whose doc_id
    is null, count as occurrences of their own; no occurrence is preferred, so
    there are no ties.  An empty table gives no rows.  Other columns stay as they
    are, whatever their names.
    """
    rest = others(docs, "n_words", "n_removed", "kept")
    keyed = docs.select(*quoted(rest), *row_key())
    covered = repeated(keyed.select("_qn_k0", "_qn_k1", "text"), kind, by_extension)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, count, removed = [], [], []
        for text, c in zip(texts_as_bytes(batch.column("text")), batch.column("_qn_covered"), strict=True):
            words = text.split()
            count.append(len(words))
            if c.is_valid:
                a, b = union_of(*(c.values.field(x).to_numpy().astype(np.int64) for x in ("a", "b")))
                for s, e in zip(a[::-1].tolist(), b[::-1].tolist(), strict=True):
                    del words[s:e]
            removed.append(count[-1] - len(words))
            kept.append(b" ".join(words))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], [*rest, "n_words", "n_removed", "kept"])

    wide = keyed.join(covered, ["_qn_k0", "_qn_k1"], "left").select(*quoted(rest), "_qn_covered")
    return map_slices(wide, fn, widened(docs, rest, "n_words long, n_removed long, kept binary")).withColumn("kept", F.col("kept").cast("string"))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
