"""Removal of lines that several documents share, with a pair of Bloom filters before the shuffle.

1. Every task hashes its lines and writes the filter positions of all keys it saw (once) and of
   those it saw in two documents or more (twice).
2. Positions are merged one filter segment at a time: a position is in the twice-seen filter if two
   tasks saw it or one task saw it twice.
3. Only lines whose positions are all in the twice-seen filter are shuffled, as whole keys. The
   smallest and the largest document of a key confirm the repeat and name the first occurrence.

A saturated filter costs shuffle, never correctness: the filter has no false negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .text import LOWER, SPACE, Texts, byte_hashes, slices

MIN_CHARS = 10
# Filter bits for each distinct line of a task, and the bound of the filter (64 MB).
BITS_PER_LINE = 16
MAX_FILTER_BITS = 1 << 29
SEGMENT_BITS = 1 << 20
# Line hashes that a task gathers before it writes their positions.
GATHER = 1 << 21


def line_keys(t: Texts, min_chars: int = MIN_CHARS):
    """Long lines of each text: (text, line number, start and length of the key, lower-cased bytes, hashes), lines per text."""
    body = t.data[:-8]
    breaks = np.flatnonzero(body == 10)
    start = np.sort(np.concatenate((t.start[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((breaks, t.start[1:])), kind="stable")
    per_text = np.diff(np.searchsorted(breaks, t.start)) + 1
    text = np.repeat(np.arange(t.count), per_text)
    number = np.arange(len(start)) - (np.cumsum(per_text) - per_text)[text]
    solid = np.append(np.flatnonzero(~SPACE[body]), len(body))
    first = solid[np.searchsorted(solid, start)]
    last = solid[np.maximum(np.searchsorted(solid, end) - 1, 0)] + 1
    last = np.where(first < end, last, first)
    points = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80, dtype=np.int64)))
    long = np.flatnonzero((first < end) & (points[np.minimum(last, len(body))] - points[np.minimum(first, len(body))] >= min_chars))
    at, size, low = first[long], (last - first)[long], LOWER[t.data]
    return text[long], number[long], at, size, low, byte_hashes(low, at, size), per_text


def _positions(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return h >> shift, (h << np.uint64(32)) >> shift


def _seen(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    """Sorted hashes of the lines of this task, and which of them two documents held."""
    held: list[np.ndarray] = []

    def flush():
        h = np.sort(np.concatenate(held))
        held.clear()
        new = np.append(True, h[1:] != h[:-1])
        distinct = h[new]
        twice = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
        return pa.RecordBatch.from_pydict({"hashes": [distinct.tobytes()], "twice": [np.packbits(twice).tobytes()], "n": [len(distinct)]})

    for b in batches:
        for t in slices(b.column("text")):
            text, _, _, _, _, h, _ = line_keys(t, min_chars)
            if len(h):  # a line counts once for each document
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                held.append(h[np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))])
            if sum(map(len, held)) > GATHER:
                yield flush()
    if held:
        yield flush()


def _to_segments(bits: int):
    segment = min(bits, SEGMENT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for hashes, twice in zip(b.column("hashes"), b.column("twice")):
                h = np.frombuffer(hashes.as_py(), np.uint64)
                often = np.unpackbits(np.frombuffer(twice.as_py(), np.uint8), count=len(h)).astype(bool)
                once = np.unique(np.concatenate(_positions(h, bits)))
                more = np.unique(np.concatenate(_positions(h[often], bits)))
                rows = np.unique(once // segment)
                cut = lambda x: np.split((x % segment).astype(np.uint32), np.searchsorted(x, rows[1:] * segment))
                yield pa.RecordBatch.from_pydict(
                    {"segment": rows.astype(np.int64), "once": [x.tobytes() for x in cut(once)], "more": [x.tobytes() for x in cut(more)]}
                )

    return run


def _merge(bits: int):
    segment = min(bits, SEGMENT_BITS)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(segment, bool), np.zeros(segment, bool)
        for b in batches:
            for x, y in zip(b.column("once"), b.column("more")):
                at = np.frombuffer(x.as_py(), np.uint32)
                twice[at[once[at]]] = True
                once[at] = True
                twice[np.frombuffer(y.as_py(), np.uint32)] = True
        yield pa.RecordBatch.from_pydict({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": [np.packbits(twice, bitorder="little").tobytes()]})

    return run


def twice_filter(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, max_bits: int = MAX_FILTER_BITS) -> np.ndarray:
    """The twice-seen filter as bytes, least significant bit first; at most ``max_bits`` bits."""
    seen = materialise(docs.select(F.col(text).alias("text")).mapInArrow(lambda b: _seen(b, min_chars), "hashes binary, twice binary, n long"), "lines")
    n = seen.agg(F.sum("n")).first()[0] or 0
    bits = 1 << 10
    while bits < min(BITS_PER_LINE * n, max_bits):
        bits *= 2
    merged = seen.mapInArrow(_to_segments(bits), "segment long, once binary, more binary").groupBy("segment").applyInArrow(_merge(bits), "segment long, bits binary")
    size = min(bits, SEGMENT_BITS) // 8
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # bounded by max_bits
        out[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def _suspects(shared, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for t in slices(b.column("text")):
                text, number, at, size, low, h, _ = line_keys(t, min_chars)
                hit = np.ones(len(h), bool)
                for p in _positions(h, len(bits) * 8):
                    hit &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
                rows = pa.array(text[hit] + t.first)
                at, size = at[hit], size[hit]
                keys = [low[i : i + n].tobytes() for i, n in zip(at.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(rows), b.column("version").take(rows), pa.array(number[hit], pa.int32()), pa.array(keys, pa.binary())],
                    ["doc_id", "version", "line", "key"],
                )

    return run


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
        texts = b.column("text").fill_null("")
        total, dropped, out = [], [], []
        for text, lines in zip(texts, b.column("lines")):
            text = text.as_py()
            gone = set(lines.as_py() or ())
            total.append(text.count("\n") + 1)
            dropped.append(len(gone))
            out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text)
        kept = [b.column(i) for i, f in enumerate(b.schema) if f.name not in ("text", "lines")]
        names = [f.name for f in b.schema if f.name not in ("text", "lines")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], [*names, "text", "n_lines", "n_dropped"])


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, keep: tuple[str, ...] = (), max_bits: int = MAX_FILTER_BITS
) -> DataFrame:
    """Drop every line whose key occurs in several documents, but for the smallest document holding it.

    The key of a line is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z
    lower-cased; keys of fewer than ``min_chars`` code points stay. Returns doc_id, text (the rest,
    joined by line feeds), n_lines (before), n_dropped and the columns named in ``keep``; other
    columns are ignored, so their names cannot clash.

    NULL or empty text: one empty line, text becomes empty. Rows with the same doc_id are one
    document, each rewritten by its own text. Rows without doc_id lose nothing and hold nothing
    back. A document that loses all lines stays, with an empty text. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(twice_filter(docs.where(F.col(key).isNotNull()), text, min_chars, max_bits))
    carry = {f"keep_{i}": c for i, c in enumerate(keep)}
    base = docs.select(
        F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(text).alias("version"), *[F.col(c).alias(a) for a, c in carry.items()]
    )
    kind = base.schema["doc_id"].dataType.simpleString()
    suspects = materialise(
        base.where(F.col("doc_id").isNotNull()).select("doc_id", "version", "text").mapInArrow(_suspects(shared, min_chars), f"doc_id {kind}, version long, line int, key binary"),
        "suspects",
    )
    repeated = suspects.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first")
    drops = suspects.join(repeated, "key").where("doc_id <> first").groupBy("doc_id", "version").agg(F.collect_set("line").alias("lines"))
    joined = base.join(drops, ["doc_id", "version"], "left").drop("version")
    fields = ", ".join([f"doc_id {kind}", *[f"{a} {base.schema[a].dataType.simpleString()}" for a in carry], "text string, n_lines long, n_dropped long"])
    out = joined.select("doc_id", *carry, "text", "lines").mapInArrow(_rewrite, fields)
    return out.select("doc_id", *[F.col(a).alias(c) for a, c in carry.items()], "text", "n_lines", "n_dropped")
