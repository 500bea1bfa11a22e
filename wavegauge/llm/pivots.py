"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its nearest reference vectors (pivots), in order. Each pivot has a list of
the vectors that name it. Inside a list, a matrix product singles out the pairs that may be near; a pair
of them that shares enough pivots is verified by its cosine, in the list of the smallest pivot it shares,
so once. Lists of more than a block are compared block by block. A list hands on link counts and the
edges that span its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import connected_components
from .frames import block_pairs, group_tables, parallelism

# Pivots: one for each so many vectors, within bounds; all drawn from the table by hash.
VECTORS_PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 32, 64, 2048
# Nearest pivots kept for a vector, and how many of them a near pair must share. Random pairs at
# cosine 0.9 in 64 dimensions share two of twelve in over 99.9 % of cases.
PREFIX, SHARED = 12, 2
# No two pivots have this cosine: many pivots in one dense spot would be shared by chance only.
APART = 0.8
BLOCK = 1024
# How far single precision may be off; the share of near pairs from which whole matrices are compared.
ROUNDING, MANY_NEAR = 1e-4, 0.02


def _unit(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 (zero where no direction exists), and which rows have one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().fill_null(0))
    x = np.zeros((len(size), width))
    x[np.arange(width) < size[:, None]] = np.asarray(column.flatten(), np.float64)
    x /= np.maximum(np.abs(x).max(1, initial=0), 1e-300)[:, None]
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm > 0


def spread(pivots: np.ndarray, most: float = APART) -> np.ndarray:
    """The pivots without those closer than ``most`` to an earlier one, so that a dense spot gives one pivot."""
    near = pivots.astype(np.float32) @ pivots.T.astype(np.float32) >= most
    keep = np.ones(len(pivots), bool)
    for i in range(len(pivots)):
        if keep[i]:
            keep[i + 1 :] &= ~near[i, i + 1 :]
    return pivots[keep]


def _describe(shared, width: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        keep = min(prefix, len(pivots))
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x, _ = _unit(part.column("v"), width)
                near = x @ pivots.T
                top = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
                order = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1).astype(np.int16)
                orders = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * keep), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("weight"), orders, part.column("v")], ["rep", "weight", "pivots", "v"])

    return run


def shared_pivots(orders: np.ndarray, pivot: int, above: bool) -> np.ndarray:
    """How many pivots above (or below) ``pivot`` each pair of rows shares."""
    n = len(orders)
    row, at = np.nonzero(orders > pivot if above else orders < pivot)
    other = orders[row, at]
    order = np.argsort(other, kind="stable")
    row = row[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(other[order])) + 1, [len(row)])) if len(row) else np.zeros(1, np.int64)
    sizes = np.diff(cuts)
    out = np.zeros((n, n), np.uint8)
    codes = []
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 12)]):
        at = cuts[:-1][sizes == size]
        for i in range(size):
            for j in range(i + 1, size):
                codes.append(row[at + i] * n + row[at + j])
    if codes:
        out += np.bincount(np.concatenate(codes), minlength=n * n).reshape(n, n).astype(np.uint8)
    for at, size in zip(cuts[:-1][sizes > 12], sizes[sizes > 12]):
        r = row[at : at + size]
        out[np.ix_(r, r)] += 1
    return np.maximum(out, out.T)


def meet(a: np.ndarray, b: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """Which pairs of rows share ``shared`` pivots of which ``pivot`` is the smallest."""
    same = np.array([(b.T == p).any(0) for p in a.T])
    return (same.sum(0) >= shared) & ~(same & (a.T < pivot)).any(0)


def linked(x: np.ndarray, orders: np.ndarray, blk: np.ndarray, pivot: int, least: float, shared: int) -> np.ndarray | None:
    """Pairs of a list, or of two blocks of it, that share enough pivots and have a cosine of at least ``least``, as a
    symmetric matrix; None without such a pair.

    Both must hold, so the cheaper test comes first: a product in single precision singles out the pairs whose
    pivots are counted and whose cosines are taken in double precision. Where many pairs are near, all are tested.
    """
    left, right = np.flatnonzero(blk == blk.min()), np.flatnonzero(blk == blk.max())
    i, j = np.nonzero(x[left].astype(np.float32) @ x[right].astype(np.float32).T >= least - ROUNDING)
    i, j = left[i], right[j]
    if left[0] == right[0]:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return None
    if len(i) > MANY_NEAR * len(left) * len(right):
        candidate = shared_pivots(orders, pivot, True) + 1 >= shared
        candidate &= shared_pivots(orders, pivot, False) == 0
        np.fill_diagonal(candidate, False)
        if left[0] != right[0]:
            candidate &= blk[:, None] != blk[None, :]
        return candidate & (x @ x.T >= least)
    ok = meet(orders[i], orders[j], pivot, shared) & (np.einsum("ij,ij->i", x[i], x[j]) >= least)
    out = np.zeros((len(x), len(x)), bool)
    out[i[ok], j[ok]] = out[j[ok], i[ok]] = True
    return out


def spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect."""
    label = np.arange(len(links))
    edges = []
    for i in np.flatnonzero(links.any(1)):
        near = np.flatnonzero(links[i, :i])
        own, first = np.unique(label[near], return_index=True)
        for x, j in zip(own.tolist(), near[first].tolist()):
            if label[i] != x:
                edges.append((int(i), j))
                a, b = sorted((int(label[i]), x))
                label[label == b] = a
    return edges


def _search(width: int, least: float, shared: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in group_tables(batches, ["pivot", "pair"], 4096):
            group = np.asarray(table["group"])
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
            reps, weights, blocks, pivot = (np.asarray(table[c]) for c in ("rep", "weight", "blk", "pivot"))
            orders = np.asarray(table["pivots"].combine_chunks().flatten()).reshape(len(group), -1)
            units, _ = _unit(table["v"], width)
            rows: list[tuple] = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a < 2:
                    continue
                links = linked(units[a:b], orders[a:b], blocks[a:b], int(pivot[a]), least, shared)
                if links is None:
                    continue
                some = np.flatnonzero(links.any(1))
                count = links[some] @ weights[a:b]
                rows += [(int(reps[a + i]), None, int(c)) for i, c in zip(some.tolist(), count.tolist())]
                rows += [(int(reps[a + i]), int(reps[a + j]), 0) for i, j in spanning(links)]
            if rows:
                u, v, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", pivots: int | None = None, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """Links of cosine ``least`` or more: vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id reachable, itself included), kept (vec_id = component_id).

    Equal vectors form one class, which is compared once and counts as often as it has rows. Vectors
    that are NULL, zero or hold NULL, NaN or infinite components link with nothing; shorter vectors
    count as padded by zeros. Rows that repeat a key are rows of their own in the counts. Rows without
    a key keep n_links and have component_id NULL and kept true. An empty table gives no rows; other
    columns are ignored. The pivots, at most ``MOST_PIVOTS``, are vectors of the table chosen by hash;
    every vector is indexed.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    # Equal directions as stored: -0.0 counts as 0.0, trailing zeros are kept.
    plain = F.transform("v", lambda x: x + F.lit(0.0))
    finite = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = materialise(base.where(F.coalesce(finite, F.lit(False)) & F.col("id").isNotNull()).select("id", plain.alias("v")).withColumn("h", F.xxhash64("v")), "vectors")
    classes = materialise(rows.groupBy("h", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "classes")
    stats = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    n, width = stats["n"], stats["w"] or 1
    m = pivots or int(min(max(n // VECTORS_PER_PIVOT, LEAST_PIVOTS), MOST_PIVOTS))
    drawn = classes.orderBy(F.xxhash64("h"), "rep").limit(m).select("v").collect()  # at most MOST_PIVOTS vectors
    reference = spread(_unit(pa.array([r["v"] for r in drawn], pa.list_(pa.float64())), width)[0]) if drawn else np.zeros((1, width))
    # Vectors travel as they are given, in single precision where they came so, and are scaled where they are compared.
    given = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    slim = classes.select("rep", "weight", F.col("v").cast(given).alias("v"))
    described = slim.mapInArrow(_describe(spark.sparkContext.broadcast(reference), width, prefix), f"rep long, weight long, pivots array<short>, v {given}")
    described = materialise(described, "described")
    posted = described.withColumn("pivot", F.explode("pivots"))
    lists = F.broadcast(described.select(F.explode("pivots").alias("pivot")).groupBy("pivot").agg((F.count("*") / F.lit(BLOCK)).alias("blocks")))  # a row for each pivot
    dealt = block_pairs(posted.join(lists, "pivot"), "rep", "blocks").select("pivot", "pair", "blk", "rep", "weight", "pivots", "v")
    dealt = dealt.repartition(parallelism(vectors), "pivot", "pair").sortWithinPartitions("pivot", "pair", "rep")
    found = materialise(dealt.mapInArrow(_search(width, least, min(shared, len(reference))), "a long, b long, n long"), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    joined = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    # Keys that repeat with other vectors are one node, named by any of their classes.
    named = classes.join(counts, "rep", "left").join(joined, "rep", "left").select("h", "v", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    known = rows.join(named, ["h", "v"]).select("id", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    others = base.where(~(F.coalesce(finite, F.lit(False)) & F.col("id").isNotNull())).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return known.unionByName(others).withColumnRenamed("id", "vec_id")
