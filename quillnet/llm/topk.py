"""Exact top-k search by inner product, term at a time.

Queries and candidates are dealt to a grid of blocks.  In a block every query's
sparse row is walked component by component: each component's posting list,
weighted, is added to a dense array of scores.  A partition selects each query's
best of the block, and a merge keeps the best of all blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 10
SCALE = 1024
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or a non-finite component."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def postings(rows: list[np.ndarray]) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each component the candidates with a weight there (None: all), and the weights."""
    width = max(map(len, rows), default=0)
    dense = np.zeros((width, len(rows)), np.int64)
    for k, r in enumerate(rows):
        dense[: len(r), k] = r
    out = []
    for t in range(width):
        there = np.flatnonzero(dense[t])
        out.append((None, dense[t]) if 4 * len(there) > len(rows) else (there, dense[t][there]))
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller place, in order of place."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.sort(np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]]))


def block_top(queries: pa.Table, candidates: pa.Table, top: int = TOP) -> pa.Table:
    """The block's best candidates of each query; the query's own row is left out."""
    ids, own = candidates.column("vec_id").to_numpy(), candidates.column("row").to_numpy()
    order = np.lexsort((own, ids))
    vectors = candidates.column("v").to_pylist()
    lists = postings([np.array(vectors[k], np.int64) for k in order.tolist()])
    ids, own = ids[order], own[order]
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    scores, weighted = np.zeros(len(ids), np.int64), np.empty(len(ids), np.int64)
    names = zip(*(queries.column(c).to_pylist() for c in ("query_id", "q_row", "q_v")), strict=True)
    for q, q_row, row in names:
        scores[:] = 0
        for t, w in enumerate(row):
            if w and t < len(lists):
                at, weights = lists[t]
                if at is None:
                    np.multiply(weights, w, out=weighted)
                    scores += weighted
                else:
                    scores[at] += weights * w
        if len(self_at := np.flatnonzero(own == q_row)):
            others = np.delete(np.arange(len(ids)), self_at)
            k = others[best(scores[others], top)]
        else:
            k = best(scores, top)
        for column, values in zip(out, (np.full(len(k), q_row), np.full(len(k), q), ids[k], own[k], scores[k]), strict=True):
            column.append(values)
    cat = [np.concatenate([np.zeros(0, np.int64), *parts]) for parts in out]
    return pa.table(dict(zip(("q_row", "query_id", "vec_id", "row", "score"), cat, strict=True)))


def top_k(candidates: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for queries (query_id, v) against candidates (vec_id, v), v array<long>.

    Both sides may have a column row (long) that numbers their rows; a query does
    not meet the candidate of its own number.  Without it ids number rows: a query
    does not meet candidates of its id, and repeated query rows count once.  Ties
    go to the smaller vec_id, then to the smaller row.  Null ids take no part;
    empty vectors score 0; components that one side lacks count as 0; vectors of
    any length are read whole, and components should stay below 2^20 for sums to
    fit a long.  An empty side gives no rows; other columns are ignored, whatever
    their names.
    """
    candidates = candidates.where("vec_id is not null").select("vec_id", "v", *(["row"] if "row" in candidates.columns else [F.col("vec_id").alias("row")]))
    queries = queries.where("query_id is not null")
    # names and attributes of their own, as both sides may stem from one table
    queries = queries.select("query_id", F.col("v").alias("q_v"), F.col("row" if "row" in queries.columns else "query_id").alias("q_row")).dropDuplicates(["q_row"])
    n_c, n_q = candidates.count(), queries.count()
    b_c, b_q = max(1, -(-n_c // CANDIDATE_BLOCK)), max(1, -(-n_q // QUERY_BLOCK))
    deal = lambda row, n: F.pmod(F.xxhash64(F.col(row)), F.lit(n)).cast("int")
    c = candidates.select("vec_id", "v", "row", deal("row", b_c).alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(b_q - 1))).alias("_q"))
    q = queries.select("query_id", "q_v", "q_row", deal("q_row", b_q).alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(b_c - 1))).alias("_c"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if "q_v" not in left.column_names or "v" not in right.column_names:  # a cell lacks one side
            none = lambda *names: pa.table({n: pa.array([], pa.list_(pa.int64()) if n[-1] == "v" else pa.int64()) for n in names})
            left, right = none("query_id", "q_row", "q_v"), none("vec_id", "row", "v")
        return block_top(left, right, top)

    found = q.groupBy("_q", "_c").cogroup(c.groupBy("_q", "_c")).applyInArrow(cell, "q_row long, query_id long, vec_id long, row long, score long")
    w = Window.partitionBy("q_row", "query_id").orderBy(F.desc("score"), "vec_id", "row")
    return found.select("query_id", F.row_number().over(w).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= top)
