"""Exact top-k search by inner product: branch and bound over dimension blocks in vertical layout.

Candidates are held column by column. For a query the blocks are visited in the order of the
query's mass; after each block every candidate has a partial score, and the mass that remains on
both sides bounds what it may still gain (Cauchy-Schwarz). Candidates that cannot reach the k-th
best score known so far are compacted away before the next block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dimensions of a block, candidates of a vertical tile, and queries and candidates of a task.
DIM_BLOCK = 16
TILE = 8192
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 65_536
LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    """Vectors that are not NULL and hold only finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) as doubles; shorter vectors are padded by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = np.floor(256 * flat)
    return out


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products beyond the exact range of doubles, in Python integers, held within 64 bits."""
    a = [int(x) for x in q]
    return np.array([max(-LONG - 1, min(LONG, sum(x * int(y) for x, y in zip(a, row)))) for row in c], dtype=object)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), int)
    return order[:k]


def search(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """The k best of the candidates for every query: arrays (query, id, score)."""
    width = q.shape[1]
    most = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
    if width * most * most >= 2**53:  # doubles would round
        for i in range(len(q_ids)):
            other = np.flatnonzero(c_ids != q_ids[i])
            s = _exact(q[i], c[other])
            for j in _best(c_ids[other], s, k):
                yield q_ids[i], c_ids[other[j]], int(s[j])
        return
    blocks = [np.arange(lo, min(lo + DIM_BLOCK, width)) for lo in range(0, width, DIM_BLOCK)]
    q_mass = np.stack([(q[:, b] ** 2).sum(1) for b in blocks], 1) if blocks else np.zeros((len(q), 0))
    tiles = []
    for lo in range(0, len(c), TILE):
        part = c[lo : lo + TILE]
        tiles.append((c_ids[lo : lo + TILE], [np.ascontiguousarray(part[:, b].T) for b in blocks], np.stack([(part[:, b] ** 2).sum(1) for b in blocks]) if blocks else np.zeros((0, len(part)))))
    for i in range(len(q)):
        order = np.argsort(-q_mass[i], kind="stable")
        ids, scores = np.empty(0, np.int64), np.empty(0)
        for t_ids, columns, mass in tiles:
            floor = scores[-1] if len(scores) == k else -np.inf
            alive = None
            partial = np.zeros(len(t_ids))
            left_q, left_c = q_mass[i].sum(), mass.sum(0)
            for b in order:
                block = columns[b] if alive is None else columns[b][:, alive]
                partial = partial + q[i, blocks[b]] @ block
                left_q = left_q - q_mass[i, b]
                left_c = left_c - (mass[b] if alive is None else mass[b][alive])
                if floor > -np.inf:
                    # Equal scores may still win by the smaller id, so they stay; one unit covers rounding.
                    keep = partial + np.sqrt(max(left_q, 0) * np.maximum(left_c, 0)) + 1 >= floor
                    if not keep.all():
                        alive = np.flatnonzero(keep) if alive is None else alive[keep]
                        partial, left_c = partial[keep], left_c[keep]
                        if not len(alive):
                            break
            found = t_ids if alive is None else t_ids[alive]
            other = found != q_ids[i]
            found, partial = found[other], partial[other]
            if len(found) > 8 * k:  # only what may rank
                near = partial >= np.partition(partial, len(partial) - k)[len(partial) - k]
                found, partial = found[near], partial[near]
            ids, scores = np.concatenate((ids, found)), np.concatenate((scores, partial))
            best = _best(ids, scores, k)
            ids, scores = ids[best], scores[best]
        for x, s in zip(ids.tolist(), scores.tolist()):
            yield q_ids[i], x, int(s)


def _block_pair(k: int, width: int):
    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        rows = []
        if len(q) and len(c):
            rows = list(search(np.asarray(q["id"]), _matrix(q["v"], width), np.asarray(c["id"]), _matrix(c["v"], width), k))
        query, vec, score = zip(*rows) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def exact_topk(
    vectors: DataFrame, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK
) -> DataFrame:
    """The k vectors of largest integer inner product for each query row (key divisible by ``every``).

    Components become floor(256 x). Every other row is a candidate; rows that repeat the query's key
    are the query itself and do not count, repeated candidates count once. Ties go to the smaller
    key. Vectors that are NULL or hold NULL, NaN or infinite components, and rows without a key take
    no part; shorter vectors count as padded by zeros. Scores beyond 64 bits are held at the limit.
    No query or an empty table gives no rows; other columns are ignored.

    Queries and candidates meet block by block, each block in one task, so the queries are neither
    collected nor broadcast.
    """
    base = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    queries = base.where(F.col("id") % every == 0)
    n = base.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q"), F.max(F.size("v")).alias("w")).first()
    at_least = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    qb = max(1, -(-n["q"] // query_block))
    cb = max(1, -(-n["n"] // candidate_block), min(at_least, n["n"] // TILE))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(qb)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1))))
    right = base.withColumn("cb", F.pmod(F.hash("id"), F.lit(cb)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    pairs = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_block_pair(k, n["w"] or 0), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
