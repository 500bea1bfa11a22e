"""Packing of tokenised documents into sequences of fixed length by fitted length patterns.

Documents are cut into pieces of at most one sequence. The histogram of piece lengths (one row for
each length) meets in one task. There, patterns of a few lengths that fill a sequence are enumerated, their repeat counts fitted to the histogram by non-negative least squares and rounded
(down, but to one at least where the pieces are there, largest first); fit and rounding repeat on
the remaining histogram until no pattern is left. The residual is packed best fit decreasing, a
whole run of equal lengths at a time, into the gaps of the patterns and into new sequences. The plan is a list of runs, "pieces k to k + n of
length L go to sequences s to s + n at this offset", so its size depends on the number of lengths
and patterns and not on the number of documents. Every piece then finds its place from its rank
among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .text import LOWER, IdPool, Texts, byte_hashes, slices, words

MAX_LENGTH = 2048
# Slices in which the pieces of a length are ranked.
SLICES = 256
# Patterns with a gap are fitted too as long as there are no more than this; those without a gap always
# (for sequences of 2 048 tokens at most 350 208). Then the steps of the fit.
MAX_PATTERNS = 400_000
# A pattern leaves at most this part of a sequence free.
WASTE = 64
FIT_STEPS = 150


# Marks at the end of a word that form a token group of their own after a letter or digit.
MARKS = ".,;:!?*&$%#)"
# Characters beyond these may change under the tokenizer's normal form.
BEYOND = re.compile("[^\x00-\u012f]")
_MARK = np.zeros(256, bool)
_MARK[list(MARKS.encode())] = True
_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(97, 123)]] = True


@lru_cache(maxsize=2)
def _encoder(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = token.endswith("</w>")
    return tokenizer, ends, IdPool()


def _encode_new(tokenizer, ends: np.ndarray, new: list[str]) -> list[np.ndarray]:
    """Ids of different words; plain words are encoded many at a time and told apart by their last tokens."""
    out: list = [None] * len(new)
    plain = [i for i, w in enumerate(new) if w.isalpha() and not BEYOND.search(w)]
    for lo in range(0, len(plain), 512):
        part = plain[lo : lo + 512]
        ids = np.asarray(tokenizer.encode_batch_fast([" ".join([new[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
        cuts = (np.flatnonzero(ends[ids]) + 1).tolist()
        for i, a, b in zip(part, [0, *cuts], cuts, strict=False):
            out[i] = ids[a:b]
    other = [i for i, x in enumerate(out) if x is None]
    for i, e in zip(other, tokenizer.encode_batch_fast([new[i] for i in other], add_special_tokens=False) if other else ()):
        out[i] = np.asarray(e.ids, np.uint32)
    return out


def encode_texts(t: Texts, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another and the number of ids of each, by a tokenizer that never joins across blanks.

    Texts are cut at ASCII white space, which this tokenizer drops, and closing marks are cut off
    ASCII words, as the tokenizer does itself. Each different word is encoded once; words are told
    apart by a 64-bit hash.
    """
    tokenizer, ends, pool = _encoder(path)
    if pool.full:
        pool.clear()
    raw, start, size, first = words(t, lower=False)
    odd = np.concatenate(([0], np.cumsum((raw[:-8] >= 128) | (raw[:-8] == 60))))
    plain = odd[start + size] == odd[start]
    low = LOWER[raw]
    core = size.copy()
    live = np.flatnonzero(plain)
    while live.size:
        live = live[(core[live] > 1) & _MARK[low[start[live] + core[live] - 1]]]
        core[live] -= 1
    core = np.where(_WORDY[low[start + core - 1]], core, size) if len(start) else core
    tail = np.flatnonzero(core < size)
    # Elements in order: every word without its marks, then its marks.
    place = np.arange(len(start)) + np.concatenate(([0], np.cumsum(core < size)))[:-1]
    n = len(start) + len(tail)
    at, length, lower = np.empty(n, np.int64), np.empty(n, np.int64), np.ones(n, bool)
    at[place], length[place], lower[place] = start, core, plain
    at[place[tail] + 1], length[place[tail] + 1] = start[tail] + core[tail], (size - core)[tail]
    h = np.empty(n, np.uint64)
    h[lower] = byte_hashes(low, at[lower], length[lower])
    h[~lower] = byte_hashes(raw, at[~lower], length[~lower])

    def make(new: np.ndarray) -> list[np.ndarray]:
        spell = [(low if lower[i] else raw)[at[i] : at[i] + length[i]].tobytes().decode() for i in new]
        return _encode_new(tokenizer, ends, spell)

    ids, counts = pool.gather(pool.entries_of(h, make))
    last = np.concatenate((place, [n]))[first]
    total = np.concatenate(([0], np.cumsum(counts)))
    return ids, np.diff(total[last])


def _pieces(path: str, size: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column("text")):
                ids, counts = encode_texts(t, path)
                full = np.full(len(ids) + t.count, end_id, "<u4")
                full[np.arange(len(ids)) + np.repeat(np.arange(t.count), counts)] = ids
                counts = counts + 1
                begin = np.cumsum(counts) - counts
                pieces = -(-counts // size)
                row = np.repeat(np.arange(t.count), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * size
                length = np.minimum(counts[row] - start, size)
                code = memoryview(full).cast("B")
                parts = [code[4 * i : 4 * (i + n)] for i, n in zip((begin[row] + start).tolist(), length.tolist())]
                arrays = [b.column("doc_id").take(pa.array(row + t.first)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([x.tobytes() for x in parts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def token_pieces(docs: DataFrame, path: str, size: int = MAX_LENGTH, end_id: int = 0, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Tokens of each document plus an end token, cut into pieces of ``size``: doc_id, piece, start,
    length, ids_crc32, with ``ids`` also the ids (binary, little-endian 32 bit). NULL text is empty."""
    kind = docs.schema[key].dataType.simpleString()
    fields = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pieces(path, size, end_id, ids), fields)


def patterns(lengths: np.ndarray, size: int, most: int = MAX_PATTERNS) -> np.ndarray:
    """Multisets of one to three of the given lengths that fill ``size`` but for a small gap, as
    indices (padded by -1). The gap starts at nothing and widens until pairs and triples are found."""
    lengths = np.sort(lengths)
    n = len(lengths)
    tail = lambda width: [np.flatnonzero(lengths >= size - width)]
    out = np.zeros((0, 3), np.int64)
    for gap in (g for g in (0, 1, 3, 7, 15, 31) if g <= size // WASTE):
        rows = [np.stack([i, np.full_like(i, -1), np.full_like(i, -1)], 1) for i in tail(gap)]
        first = np.arange(n)
        for third in [-1, *range(n)]:
            rest = size - (lengths[third] if third >= 0 else 0)
            a = first[: third + 1] if third >= 0 else first  # third is the largest of three
            lo, hi = np.searchsorted(lengths, rest - lengths[a] - gap), np.searchsorted(lengths, rest - lengths[a], "right")
            lo = np.maximum(lo, a)
            hi = np.minimum(hi, third + 1) if third >= 0 else hi
            count = np.maximum(hi - lo, 0)
            if count.any():
                i = np.repeat(a, count)
                j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
                rows.append(np.stack([i, j, np.full_like(i, third)], 1))
        found = np.concatenate(rows)
        if gap and len(found) > most:
            break
        out = found
        if len(out) > 20 * n:
            break
    return out


def fit_repeats(use: np.ndarray, counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 of the patterns so that their lengths make ``counts``.

    Accelerated projected gradient; a pattern touches at most three lengths, so the matrix stays sparse.
    """
    n, used = len(counts), use >= 0
    flat, owner = use[used], np.nonzero(used)[0]
    load = lambda x: np.bincount(flat, x[owner], n)
    back = lambda r: np.where(used, r[use], 0).sum(1)
    # Jacobi scaling: the row sums of A'A bound its spectrum.
    rate = 1 / np.maximum(back(load(np.ones(len(use)))), 1)
    x = y = np.zeros(len(use))
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(y - rate * back(load(y) - counts), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def round_repeats(x: np.ndarray, use: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """(pattern, whole repeats) in the order of the fitted repeats ``x``: rounded down, but one at
    least, and no more than the pieces that are still there. ``counts`` is reduced accordingly."""
    out = []
    for p in np.argsort(-x, kind="stable"):
        if x[p] <= 0:
            break
        parts = [i for i in use[p].tolist() if i >= 0]
        n = min(max(int(x[p] + 1e-9), 1), *(int(counts[i]) // parts.count(i) for i in parts))
        if n:
            for i in parts:
                counts[i] -= n
            out.append((int(p), n))
    return out


def fit_patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) and their whole repeats; fitted again on what rounding left."""
    lengths = np.array(sorted(k for k, v in histogram.items() if v and k < size), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    out = []
    while len(lengths):
        use = patterns(lengths, size)
        found = round_repeats(fit_repeats(use, counts.astype(float)), use, counts) if len(use) else []
        if not found:
            break
        out += [(tuple(int(lengths[i]) for i in use[p] if i >= 0), n) for p, n in found]
        lengths, counts = lengths[counts > 0], counts[counts > 0]
    return out


def plan(histogram: dict[int, int], size: int = MAX_LENGTH) -> np.ndarray:
    """Runs (length, first rank, first sequence, pieces, offset) that place every piece of the histogram.

    If the tokens would fit into fewer sequences, the patterns of the widest gaps are dissolved, half of
    the rest at a time, and the plan of fewest sequences counts, of these the one with most patterns.
    """
    fitted = sorted(fit_patterns(histogram, size), key=lambda f: size - sum(f[0]))
    least = -(-sum(k * v for k, v in histogram.items()) // size)
    best, fewest, keep = None, 0, len(fitted)
    while best is None or (fewest > least and keep):
        keep = keep if best is None else keep // 2
        runs = place_runs(histogram, size, fitted[:keep])
        need = int((runs[:, 2] + runs[:, 3]).max(initial=0))
        if best is None or need < fewest:
            best, fewest = runs, need
    return best


def place_runs(histogram: dict[int, int], size: int, fitted: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Runs of full pieces, of the given patterns and, best fit decreasing, of all other pieces."""
    left = {int(k): int(v) for k, v in histogram.items() if v}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: [(first sequence, sequences)]
    free: list[int] = []
    sequences = 0

    def put(length: int, base: int, n: int, offset: int) -> None:
        runs.append((length, rank[length], base, n, offset))
        rank[length] += n
        left[length] -= n

    def open_room(gap: int, base: int, n: int) -> None:
        if gap > 0:
            if gap not in room:
                insort(free, gap)
            room.setdefault(gap, []).append((base, n))

    for parts, n in [*([((size,), left[size])] if size in left else []), *fitted]:
        offset = 0
        for x in parts:
            put(x, sequences, n, offset)
            offset += x
        open_room(size - offset, sequences, n)
        sequences += n
    for length in sorted((k for k, v in left.items() if v), reverse=True):  # best fit decreasing
        while left[length]:
            at = bisect_left(free, length)
            if at == len(free):
                n = left[length]
                fit = size // length
                new = -(-n // fit)
                put(length, sequences, new, 0)
                open_room(size - length, sequences, new)
                sequences += new
                continue
            gap = free[at]
            base, n = room[gap].pop()
            if not room[gap]:
                del room[gap]
                free.pop(at)
            take = min(n, left[length])
            put(length, base, take, size - gap)
            open_room(gap - length, base, take)
            if take < n:
                open_room(gap, base + take, n - take)
    return np.array(runs, np.int64).reshape(-1, 5)


def _plan_rows(size: int):
    """One row: the plan of the histogram rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        histogram: dict[int, int] = {}
        for b in batches:
            histogram |= dict(zip(b.column("length").to_pylist(), b.column("n").to_pylist(), strict=True))
        if not histogram:
            return
        yield pa.RecordBatch.from_arrays([pa.array([plan(histogram, size).tobytes()], pa.binary())], ["runs"])

    return run


def _place(runs: np.ndarray):
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = (runs[:, 0] << 40) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = np.asarray(b.column("rank"))
            r = runs[np.searchsorted(keys, (np.asarray(b.column("length")) << 40) + rank, "right") - 1]
            names = [f.name for f in b.schema if f.name != "rank"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(r[:, 2] + rank - r[:, 1]), pa.array(r[:, 4])], [*names, "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, path: str, size: int = MAX_LENGTH, end_id: int = 0, key: str = "doc_id", text: str = "text", ids: bool = False, slices: int = SLICES) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens: one row per piece with doc_id,
    piece, start, length, ids_crc32, sequence_id and offset (with ``ids`` also the ids).

    Only documents longer than ``size`` are cut. NULL or empty text gives one piece, the end token.
    Every row is a document of its own, also where doc_id repeats or is NULL. An empty table gives
    no rows; other columns are ignored.
    """
    pieces = materialise(token_pieces(docs, path, size, end_id, key, text, ids), "pieces")
    pieces = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int"))
    counts = pieces.groupBy("length", "slice").count()
    histogram = counts.groupBy("length").agg(F.sum("count").alias("n"))  # at most ``size`` rows
    planned = histogram.repartition(1).mapInArrow(_plan_rows(size), "runs binary").first()  # none for an empty table
    runs = np.frombuffer(planned["runs"], np.int64).reshape(-1, 5) if planned else plan({size: 1}, size)
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # The ranks and the counts are dealt by length and slice alike, so the join needs no further shuffle.
    offsets = counts.select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(own) - 1).join(offsets, ["length", "slice"])
    columns = [c for c in pieces.columns if c != "slice"]
    ranked = ranked.select(*columns, (F.col("ahead") + F.col("r")).cast("long").alias("rank"))
    fields = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in columns) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(runs), fields)
