"""Exact top-k search by term-at-a-time accumulation.

Vectors are integer rows; a term is a component. Candidates are cut into
blocks, and every block holds one posting list per term: the candidates with a
non-zero weight, and the weights. A query row scatters `its weight x posting
weights` of each of its non-zero terms into a dense score array over the block;
partition selection takes the best of the array, and the lists of all blocks
are merged per query. Queries are blocked as well, so a task holds one block
of each and one score array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
PARTIAL = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "vec", scale: float = 64.0) -> DataFrame:
    """`vec_id, weights`: components as floor(scale * x).

    Rows without ID, and vectors that are null or hold a null or non-finite
    component, are left out. Rows equal in ID and weights count once; an ID
    with several different vectors takes part with each of them.
    """
    x = F.col(vector).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (
        vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & sound)
        .select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("weights"))
        .distinct()
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Weights as rows; components that a shorter vector lacks are zero."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    rows = np.zeros((len(sizes), width), dtype=np.int64)
    rows[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return rows


def _width(column: pa.ChunkedArray) -> int:
    """Length of the longest vector."""
    return pc.max(pc.list_value_length(column)).as_py() or 0


def postings(weights: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """Per term the candidates with a non-zero weight and the weights.

    A list that covers most of the block is kept dense, over all candidates.
    """
    found = []
    for column in weights.T:
        at = np.flatnonzero(column)
        dense = 4 * len(at) > 3 * len(column)
        found.append((slice(None), np.ascontiguousarray(column)) if dense else (at, column[at]))
    return found


def block_top(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query IDs, candidate IDs and scores of the best `k` of one block, ties to smaller IDs."""
    order = np.argsort(ids, kind="stable")
    ids, weights = ids[order], weights[order]
    n = len(ids)
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(weights).max(initial=0)) * max(1, weights.shape[1])
    kind = np.int32 if bound < 2**31 else np.int64
    lists = postings(weights.astype(kind))
    scores, step = np.empty(n, dtype=kind), np.empty(n, dtype=kind)
    first, last = np.searchsorted(ids, query_ids, "left"), np.searchsorted(ids, query_ids, "right")
    out_q, out_c, out_s = [], [], []
    for q, row in enumerate(queries.astype(kind)):
        scores[:] = 0
        for term in np.flatnonzero(row):
            at, listed = lists[term]
            if isinstance(at, slice):
                scores += np.multiply(listed, row[term], out=step)
            else:
                scores[at] += listed * row[term]
        own = last[q] - first[q]
        take = min(k + own, n)
        if take < n:  # every score above the take-th is in, the rest filled up with the smallest positions
            at = np.argpartition(scores, n - take)[n - take :]
            edge = scores[at].min()
            above = np.flatnonzero(scores > edge)
            at = np.concatenate([above, np.flatnonzero(scores == edge)[: take - len(above)]])
        else:
            at = np.arange(n)
        at = at[(at < first[q]) | (at >= last[q])]
        at = at[np.lexsort((at, -scores[at].astype(np.int64)))][:k]
        out_q.append(np.full(len(at), query_ids[q]))
        out_c.append(ids[at])
        out_s.append(scores[at].astype(np.int64))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_q, out_c, out_s))


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 20,
    candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """`query_id, rank, vec_id, score`: the `k` highest inner products of every query row.

    `vectors` comes from `integer_vectors`; `is_query` chooses the queries by
    ID. A query's own ID is no candidate. Ties go to the smaller ID; a query
    has all candidates if there are fewer than `k`. No vectors or no queries
    give no rows. Every query meets every block once: a cell of the grid holds
    about `query_block` queries and `candidate_block` candidates.
    """
    counts = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, groups = -(-counts["n"] // candidate_block) or 1, -(-counts["q"] // query_block) or 1

    def cut(parts: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "weights"), F.lit(parts)).cast("int")

    def every(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    candidates = vectors.select("vec_id", "weights", cut(blocks).alias("block"), every(groups).alias("group"))
    queries = vectors.filter(is_query).select("vec_id", "weights", cut(groups).alias("group"), every(blocks).alias("block"))

    def cell(asked: pa.Table, offered: pa.Table) -> pa.Table:
        empty = not asked.num_rows or not offered.num_rows
        found = [np.zeros(0, np.int64)] * 3
        if not empty:
            width = max(_width(asked["weights"]), _width(offered["weights"]))
            found = block_top(
                asked["vec_id"].to_numpy(), _matrix(asked["weights"], width),
                offered["vec_id"].to_numpy(), _matrix(offered["weights"], width), k,
            )
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    partial = queries.groupBy("group", "block").cogroup(candidates.groupBy("group", "block")).applyInArrow(cell, PARTIAL)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
