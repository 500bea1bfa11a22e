"""Cross-entropy difference: documents scored by a target and a background language model.

Both models are byte n-grams over the one vocabulary of 256 byte values, with the same orders and the
same smoothing; they differ in what they count. The background counts every document, the target the
documents marked as such. Grams are counted exactly, by their bytes: documents are dealt into blocks
of bounded text, a block's distinct grams are counted within it, and Spark adds up the counts of each
gram over all blocks. Every block then gets back the totals of its own grams, so the statistics grow
with the input while a task holds one block's. A token's loss difference is -log p_target + log
p_background given the bytes before it; a document's score is the mean over its tokens, lower the
closer it is to the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import parallelism
from .text import Texts, mix64, slices

ORDER = 5
# Weight, in counts, of the next lower order.
PRIOR = 5.0
# Bytes of text in a block, about; rows in a batch of grams.
BLOCK_BYTES = 1 << 23
BATCH = 1 << 16
# Kinds of rows within a block, in their order: what is known about the texts, then the texts.
KNOWN, TEXT = 0, 1


def gram_windows(t: Texts, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The ``order`` bytes that begin at each byte as a number, first byte highest, and the bytes left to the end of the text."""
    size = len(t.data) - 8
    left = np.repeat(t.start[1:], np.diff(t.start)) - np.arange(size)
    return np.ndarray((size,), ">u8", t.data, strides=(1,)).astype(np.uint64) >> np.uint64(64 - 8 * order), left


def gram_key(gram: np.ndarray, n: int) -> np.ndarray:
    """A gram of ``n`` bytes as one number, exact up to 7 bytes."""
    return (gram << np.uint64(3)) | np.uint64(n)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys once each, and the sums of their rows of ``counts``; ``keys`` are sorted."""
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new, axis=0) if len(new) else counts


class BlockCounts:
    """Counts (background, target) of the windows of a block, and from them of all its grams."""

    def __init__(self, order: int):
        self.order = order
        self.clear()

    def clear(self) -> None:
        self.parts = [(np.zeros(0, np.uint64), np.zeros((0, 2), np.int64))]

    def add(self, t: Texts, target: np.ndarray) -> None:
        windows, left = gram_windows(t, self.order)
        kept = np.minimum(left, self.order).astype(np.uint64)
        gone = (np.uint64(self.order) - kept) << np.uint64(3)
        key = gram_key((windows >> gone) << gone, 0) | kept
        mine = np.repeat(target[t.first : t.first + t.count], np.diff(t.start))
        u, n = np.unique((key << np.uint64(1)) | mine, return_counts=True)
        self.parts.append(_summed(u >> np.uint64(1), np.stack([n, n * (u & np.uint64(1)).astype(np.int64)], 1)))
        if len(self.parts) > 8:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts])
        by = np.argsort(keys, kind="stable")
        self.parts = [_summed(keys[by], np.concatenate([c for _, c in self.parts])[by])]
        return self.parts[0]

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys and counts of the grams of 0 to ``order`` bytes; that of no bytes counts all bytes."""
        keys, counts = self.merge()
        size, window = keys & np.uint64(7), keys >> np.uint64(3)
        for n in range(self.order + 1):
            some = size >= n
            k, c = _summed(window[some] >> np.uint64(8 * (self.order - n)), counts[some])
            yield gram_key(k, n), c


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Rows of one block and one kind at a time, of a partition sorted by both."""
    for b in batches:
        block, kind = (np.asarray(b.column(c)) for c in ("block", "kind"))
        edges = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
            if hi > lo:
                yield int(block[lo]), int(kind[lo]), b.slice(lo, hi - lo)


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, marks = BlockCounts(order), None, []

        def out() -> Iterator[pa.RecordBatch]:
            for keys, counts in held.grams():
                for lo in range(0, len(keys), BATCH):
                    k, c = keys[lo : lo + BATCH], counts[lo : lo + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), at, np.int64)), pa.array(k.astype(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1])], ["block", "key", "background", "target"])
            held.clear()

        for block, kind, b in _stretches(batches):
            if block != at:
                yield from out()
                at, marks = block, []
            if kind == KNOWN:
                marks.append(b.column("doc_id"))
                continue
            ids = b.column("doc_id")
            target = np.asarray(pc.is_in(ids, pa.concat_arrays(marks)) if marks else np.zeros(len(ids), bool), bool)
            for t in slices(b.column("text"), 1 << 20):
                held.add(t, target)
        yield from out()

    return run


class BlockModel:
    """Losses of bytes under (background, target), from the counts of a block's grams."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int):
        by = np.argsort(keys)
        self.order, self.keys, self.counts = order, keys[by], counts[by].astype(np.float64)
        size = self.keys & np.uint64(7)
        self.full = self.keys[size == order] >> np.uint64(3)
        self.full_losses = self.losses(self.full, order)
        bits = max(8, int(len(self.full) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slot = np.zeros(1 << bits, np.int32)
        self.slot[mix64(self.full) >> self.shift] = np.arange(len(self.full))

    def count(self, gram: np.ndarray, n: int) -> np.ndarray:
        return self.counts[np.searchsorted(self.keys, gram_key(gram, n))]

    def losses(self, gram: np.ndarray, n: int) -> np.ndarray:
        """Loss in nats of the last byte of grams of ``n`` bytes, given those before it."""
        last = lambda m: gram & np.uint64((1 << (8 * m)) - 1)
        if not len(gram):
            return np.zeros((0, 2))
        p = (self.count(last(1), 1) + PRIOR / 256) / (self.count(np.zeros(1, np.uint64), 0) + PRIOR)
        for m in range(2, n + 1):
            whole, context = self.count(last(m), m), self.count(last(m) >> np.uint64(8), m - 1)
            p = (np.minimum(whole, context) + PRIOR * p) / (context + PRIOR)
        return -np.log(p)

    def find(self, gram: np.ndarray) -> np.ndarray:
        """Rows of ``full`` of grams that are all there; a slot is a guess, which is checked."""
        out = self.slot[mix64(gram) >> self.shift]
        wrong = np.flatnonzero(self.full[out] != gram)
        out[wrong] = np.searchsorted(self.full, gram[wrong])
        return out

    def sums(self, t: Texts) -> np.ndarray:
        """Bytes and summed losses of every text."""
        windows, left = gram_windows(t, self.order)
        length = np.diff(t.start)
        total = np.zeros((t.count, 3))
        total[:, 0] = length
        whole = np.flatnonzero(left >= self.order)
        if len(whole):
            at = self.find(windows[whole])
            end = np.concatenate(([0], np.cumsum(np.maximum(length - self.order + 1, 0))))
            for which in (0, 1):
                run = np.concatenate(([0.0], np.cumsum(self.full_losses[at, which])))
                total[:, 1 + which] = run[end[1:]] - run[end[:-1]]
        for n in range(1, self.order):  # the first bytes of a text have fewer before them
            some = np.flatnonzero(length >= n)
            total[some, 1:] += self.losses(windows[t.start[some]] >> np.uint64(8 * (self.order - n)), n)
        return total


def _score(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, model = None, [], None
        for block, kind, b in _stretches(batches):
            if block != at:
                at, known, model = block, [], None
            if kind == KNOWN:
                known.append([np.asarray(b.column(c)) for c in ("key", "background", "target")])
                continue
            if model is None:
                keys, *counts = [np.concatenate(x) for x in zip(*known)] if known else [np.zeros(0, np.int64)] * 3
                model, known = BlockModel(keys.astype(np.uint64), np.stack(counts, 1), order), []
            s = np.concatenate([model.sums(t) for t in slices(b.column("text"), 1 << 20)])
            n = np.maximum(s[:, 0], 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(s[:, 0].astype(np.int64)), pa.array(s[:, 2] / n), pa.array(s[:, 1] / n), pa.array((s[:, 2] - s[:, 1]) / n)],
                ["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
            )

    return run


def _by_block(known: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Blocks one after another in each partition, in each what is known before the texts."""
    both = known.withColumn("kind", F.lit(KNOWN)).unionByName(texts.withColumn("kind", F.lit(TEXT)), allowMissingColumns=True)
    return both.repartition(n, "block").sortWithinPartitions("block", "kind")


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Score every whole text: doc_id, n_tokens, target_loss, background_loss and score, the mean of
    the per-token loss differences (nats; negative: nearer to the target).

    ``targets`` names the target documents by ``key``. All documents are counted for the background,
    all of ``targets`` for the target. NULL or empty text: no tokens, losses and score 0. Repeated
    rows are counted and scored each; rows without a key are background. Without any target document
    the target model is the uniform prior. An empty table gives no rows; other columns are ignored.
    ``order`` is at most 7; the size of a block changes no result.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parallelism(docs)
    blocks = max(1, -(-size // block_bytes))  # of the text alone: each block asks for its own grams again
    # A document and its mark meet by the key; rows without a key are dealt by their text.
    kind = base.schema["doc_id"].dataType
    texts = base.withColumn("block", F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")), F.lit(blocks)))
    marks = targets.where(F.col(key).isNotNull()).select(F.col(key).cast(kind).alias("doc_id")).distinct().withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    counts = _by_block(marks, texts, parts).mapInArrow(_count(order), "block long, key long, background long, target long")
    every = Window.partitionBy("key")  # at most one row a block
    totals = counts.select("block", "key", *[F.sum(c).over(every).alias(c) for c in ("background", "target")])
    return _by_block(totals, texts, parts).mapInArrow(_score(order), f"doc_id {kind.simpleString()}, n_tokens long, target_loss double, background_loss double, score double")
