"""Phrase collocations by dynamic itemset counting.

The corpus is cut into a few shards that are scanned in a cycle, one shard a step. Words are counted from
the first step on. A longer phrase becomes active as soon as both phrases that it consists of (all but its
last and all but its first word) have reached the threshold, is counted from the next step on, next to
phrases of other lengths, and is done when it has seen every shard once. The cycle ends when nothing is active.

A task looks phrases up in a Bloom filter: those that have reached the threshold, and, under another hash,
those that did so within the last cycle. A false hit counts a phrase too early or needlessly, never too little: counts are kept
by step, and only those of a phrase's own cycle are added, by exact joins of the few phrases that matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path, materialise
from .audit import pack_words, unpack_words
from .frames import parallelism
from .repetition import word_codes
from .text import LOWER, byte_hashes, mix64, runs, slices, words

THRESHOLD = 30
LONGEST = 4
SCALE = 2_000_000
CONTAINED_PERCENT = 80
TOP = 2000
SHARDS = 2
# Bytes that part words, and bytes that part pieces: [\x20\x09] and [.,;:!?\x0A-\x0D].
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09]] = True
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLOCK_BYTES = 1 << 21
# Counted phrases that a task adds up together, about.
PIECE_PHRASES = 1 << 20
# Bits for each phrase in a filter and the bound of a filter (32 MB); a full filter costs shuffle, not correctness.
BITS_PER_PHRASE = 16
MAX_FILTER_BITS = 1 << 28
SEGMENT = 1 << 16
# Words of the corpus for each phrase with a share of the threshold, about (sizes a filter), and the rows of a broadcast side.
HEAVY_WORDS = 64
BROADCAST_PHRASES = 20_000
_FOLD = np.uint64(0x94D049BB133111EB)


class Filter:
    """A Bloom filter over 64-bit hashes; the bits are bytes, least significant bit first."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(h: np.ndarray, n: int) -> Iterator[np.ndarray]:
        step = mix64(h) | np.uint64(1)
        for i in range(4):
            yield (h + np.uint64(i) * step) & np.uint64(n - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self.places(h, len(self.bits) * 8):
            out &= (self.bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


# Phrases that reached the threshold within the last cycle are in the same filter once more, under another hash.
RECENT = np.uint64(0x5851F42D4C957F2D)


def _grow(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word at its end."""
    return mix64(h * _FOLD + word)


def _hash_of(text: str) -> np.uint64:
    raw = np.frombuffer(text.encode() + bytes(8), np.uint8)
    return byte_hashes(raw, np.zeros(1, np.int64), np.array([len(raw) - 8]))[0]


def phrase_hashes(lang: pa.Array, phrase: pa.Array) -> np.ndarray:
    """Hashes of phrases of several languages, as the scan makes them."""
    coded = lang.dictionary_encode()
    seeds = np.array([_hash_of(x) for x in coded.dictionary.to_pylist()], np.uint64)
    out = [np.zeros(0, np.uint64)]
    seed = seeds[np.asarray(coded.indices)]
    for t in slices(phrase):
        data, start, length, first = words(t, lower=False)
        h, of = seed[t.first : t.first + t.count].copy(), byte_hashes(data, start, length)
        size = np.diff(first)
        for j in range(int(size.max(initial=0))):
            more = np.flatnonzero(size > j)
            h[more] = _grow(h[more], of[first[:-1][more] + j])
        out.append(h)
    return np.concatenate(out)


def filter_bits(n: int, most_bits: int = MAX_FILTER_BITS) -> int:
    bits = 1 << 12
    while bits < min(BITS_PER_PHRASE * n, most_bits):
        bits *= 2
    return bits


def build_filter(hashes: DataFrame, bits: int) -> Filter:
    """A filter of ``bits`` bits over a table of packed 64-bit hashes (column h); only the filter reaches the driver."""
    segment = min(bits // 8, SEGMENT)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for h in b.column("h"):
                for p in Filter.places(np.frombuffer(h.as_py(), np.uint64), bits):
                    np.bitwise_or.at(own, p >> np.uint64(3), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        parts = own.reshape(-1, segment)
        for i in np.flatnonzero(parts.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"segment": pa.array([i], pa.int64()), "bits": [parts[i].tobytes()]})

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(segment, np.uint8)
        for b in batches:
            for x in b.column("bits"):
                out |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_pydict({"segment": pa.array([key[0].as_py()], pa.int64()), "bits": [out.tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    for row in hashes.mapInArrow(mark, "segment long, bits binary").groupBy("segment").applyInArrow(merge, "segment long, bits binary").collect():  # bounded by bits
        out[row["segment"] * segment : (row["segment"] + 1) * segment] = np.frombuffer(row["bits"], np.uint8)
    return Filter(out)


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed hashes of phrases (lang, phrase, recent)."""
    for b in batches:
        h = phrase_hashes(b.column("lang"), b.column("phrase"))
        yield pa.RecordBatch.from_pydict({"h": [np.concatenate((h, h[np.asarray(b.column("recent"), bool)] ^ RECENT)).tobytes()]})


def _hash_counted(least: int):
    """Packed hashes of the phrases with ``least`` counts or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, lang, _, phrases, counts in zip(*b.columns):
                hit = np.flatnonzero(np.frombuffer(counts.as_py(), np.int64) >= least)
                if len(hit):
                    strings = unpack_words(phrases.as_py())[0].take(pa.array(hit)).cast(pa.large_string())
                    yield pa.RecordBatch.from_pydict({"h": [phrase_hashes(pa.array([lang.as_py()] * len(hit)), strings).tobytes()]})

    return run


def _blocks(shards: int, block_bytes: int):
    """Blocks of texts of one language as word numbers (-1 between pieces) over their own vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() if TaskContext.get() else 0
        member = ~(BLANKS | BREAKS)
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            of = np.asarray(langs.indices)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                for t in slices(b.column("text").take(pa.array(np.flatnonzero(of == i))), block_bytes):
                    start, length = runs(t, member)
                    code, vocabulary = word_codes(LOWER[t.data], start, length, whole=member)
                    if not len(code):
                        continue
                    packed, _, by = pack_words(vocabulary)
                    number = np.empty(len(by), np.int32)
                    number[by] = np.arange(len(by), dtype=np.int32)
                    breaks = np.cumsum(BREAKS[t.data[:-8]], dtype=np.int32)[start]
                    text = np.searchsorted(t.start, start, "right")
                    new = np.append(False, (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1]))
                    tokens = np.full(len(code) + int(new.sum()), -1, np.int32)
                    tokens[np.arange(len(code)) + np.cumsum(new)] = number[code]
                    yield pa.RecordBatch.from_pydict(
                        {"turn": pa.array([turn % shards], pa.int32()), "lang": [lang], "n_words": pa.array([len(code)], pa.int64()), "vocabulary": [packed], "tokens": [tokens.tobytes()]}
                    )
                    turn += 1

    return run


BLOCK = "turn int, lang string, n_words long, vocabulary binary, tokens binary"


def _joined(vocabulary: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    blank = pa.scalar(b" ", pa.large_binary())
    return pc.binary_join_element_wise(*[vocabulary.take(pa.array(c)) for c in columns], blank)


def block_phrases(lang: str, vocabulary: pa.Array, tokens: np.ndarray, count_words: bool, reached: Filter, lengths: set[int], longest: int):
    """Active phrases of a block and their counts: (length, phrases, counts).

    ``lengths`` are those of recent phrases: one more word may be active.
    """
    if count_words:
        yield 1, vocabulary, np.bincount(tokens[tokens >= 0], minlength=len(vocabulary))
    if not lengths:
        return
    offsets = np.frombuffer(vocabulary.buffers()[1], np.int64, len(vocabulary) + 1)
    raw = np.append(np.frombuffer(vocabulary.buffers()[2], np.uint8), np.zeros(8, np.uint8))
    of_word = byte_hashes(raw, offsets[:-1], np.diff(offsets))
    # For phrases of the length so far: their words, hashes, and whether they are in the filters.
    parts = [np.arange(len(vocabulary))]
    h = _grow(np.full(len(vocabulary), _hash_of(lang)), of_word)
    here = tokens.astype(np.int64)
    for k in range(2, longest + 1):
        if max(lengths) < k - 1:
            return
        known, new = reached.has(h), reached.has(h ^ RECENT)
        here = np.where((here >= 0) & np.append(known, False)[here], here, -1)  # -1 is the last entry
        at = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
        key, inverse, count = np.unique(here[at] * len(h) + here[at + 1], return_inverse=True, return_counts=True)
        if not len(key):
            return
        a, b = key // len(h), key % len(h)
        active = np.flatnonzero(new[a] | new[b])
        parts = [p[a] for p in parts] + [parts[-1][b]]
        if k - 1 in lengths and len(active):
            yield k, _joined(vocabulary, [p[active] for p in parts]), count[active]
        h = _grow(h[a], of_word[parts[-1]])
        there = np.full(len(here), -1, np.int64)
        there[at] = inverse
        here = there


def _scan(count_words: bool, reached, lengths: set[int], longest: int, pieces: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, vocabulary, tokens in zip(*[b.column(c) for c in ("lang", "vocabulary", "tokens")]):
                lang = lang.as_py()
                found = block_phrases(lang, unpack_words(vocabulary.as_py())[0], np.frombuffer(tokens.as_py(), np.int32), count_words, reached.value, lengths, longest)
                for k, phrases, count in found:
                    packed, hashes, by = pack_words(phrases)
                    _, ends = unpack_words(packed)
                    piece, at = np.unique(((hashes >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32), return_index=True)
                    at = np.append(at, len(by))
                    cut = np.append(0, ends)[at]
                    count = count[by].astype(np.int64)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "piece": piece.astype(np.int32),
                            "lang": [lang] * len(piece),
                            "k": pa.array(np.full(len(piece), k, np.int32)),
                            "phrases": [packed[lo:hi] for lo, hi in zip(cut[:-1], cut[1:])],
                            "counts": [count[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:])],
                        }
                    )

    return run


COUNTS = "piece int, lang string, k int, phrases binary, counts binary"


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of equal phrases; rows of one piece, language and length follow each other."""
    held: list[tuple[pa.Array, np.ndarray]] = []
    at, size = None, 0

    def merge() -> tuple[pa.Array, np.ndarray]:
        coded = pa.concat_arrays([p for p, _ in held]).dictionary_encode()
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, np.asarray(coded.indices), np.concatenate([c for _, c in held]))
        return coded.dictionary, total

    def out() -> pa.RecordBatch:
        phrases, total = merge()
        packed, _, by = pack_words(phrases)
        row = [pa.array([v], t) for v, t in zip(at, (pa.int32(), pa.string(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*row, pa.array([packed]), pa.array([total[by].tobytes()])], ["piece", "lang", "k", "phrases", "counts"])

    for b in batches:
        for piece, lang, k, phrases, counts in zip(*b.columns):
            key = (piece.as_py(), lang.as_py(), k.as_py())
            if key != at:
                if held:
                    yield out()
                held, at, size = [], key, 0
            held.append((unpack_words(phrases.as_py())[0], np.frombuffer(counts.as_py(), np.int64)))
            size += len(held[-1][1])
            if size > 2 * PIECE_PHRASES and len(held) > 1:
                held = [merge()]
                size = 0
    if held:
        yield out()


def _select(among):
    """Single rows (lang, k, phrase, c) of the counted phrases in a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, lang, k, phrases, counts in zip(*b.columns):
                strings, count = unpack_words(phrases.as_py())[0].cast(pa.large_string()), np.frombuffer(counts.as_py(), np.int64)
                hit = np.flatnonzero(among.value.has(phrase_hashes(pa.array([lang.as_py()] * len(count)), strings)))
                for lo in range(0, len(hit), 50_000):
                    some = hit[lo : lo + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang.as_py()] * len(some), pa.string()), pa.array(np.full(len(some), k.as_py(), np.int32)), strings.take(pa.array(some)).cast(pa.string()), pa.array(count[some])],
                        ["lang", "k", "phrase", "c"],
                    )

    return run


ROWS = "lang string, k int, phrase string, c long"


def _front(phrase: Column) -> Column:
    return F.regexp_replace(phrase, " [^ ]*$", "")


def _back(phrase: Column) -> Column:
    return F.regexp_replace(phrase, "^[^ ]* ", "")


def _in_own_cycle(hits: DataFrame, reached: DataFrame, shards: int, side=lambda df: df) -> DataFrame:
    """(lang, k, phrase, n): counts of the steps of each phrase's own cycle, by the steps at which its parts reached the threshold."""
    one = hits.where("k = 1").withColumn("start", F.lit(0))
    part = lambda name: reached.select("lang", F.col("phrase").alias(name), F.col("reach").alias(f"at_{name}"))
    more = hits.where("k > 1").withColumns({"front": _front(F.col("phrase")), "back": _back(F.col("phrase"))})
    more = more.join(side(part("front")), ["lang", "front"]).join(side(part("back")), ["lang", "back"]).withColumn("start", F.greatest("at_front", "at_back") + 1)
    both = one.unionByName(more.select(*one.columns))
    return both.where(F.col("step").between(F.col("start"), F.col("start") + shards - 1)).groupBy("lang", "k", "phrase").agg(F.sum("c").alias("n"))


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words found at least ``threshold`` times, and the words of each language.

    Returns (lang, k, phrase, n) with exact counts and (lang, n). Every task holds one block of text, or the
    phrases of one piece. Filters of bounded size are broadcast; everything that grows is a table.
    """
    if longest < 1 or shards < 1 or threshold < 1:
        raise ValueError("longest, shards and threshold must be positive")
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    path = fresh_path(spark, "blocks")
    base.mapInArrow(_blocks(shards, block_bytes), BLOCK).write.option("compression", "zstd").partitionBy("turn").parquet(path)
    blocks = spark.read.schema(BLOCK).parquet(path)
    totals = materialise(blocks.groupBy("lang").agg(F.sum("n_words").alias("n")), "words")
    every = totals.agg(F.sum("n")).first()[0] or 0
    tasks = parallelism(docs)
    pieces = max(tasks, -(-every // (shards * PIECE_PHRASES)))

    empty = spark.createDataFrame([], "lang string, k int, phrase string, reach int")
    together = lambda dfs: reduce(DataFrame.unionByName, dfs)
    counted, reached = [], empty
    sizes: dict[tuple[int, int], int] = {}  # phrases of a length that reached the threshold at a step
    step, last = 0, shards - 1
    while step <= last:
        recent = {k for k, at in sizes if k < longest and at >= step - shards}
        known = reached.where(F.col("k") < longest).select("lang", "phrase", (F.col("reach") >= step - shards).alias("recent"))
        held = spark.sparkContext.broadcast(build_filter(known.mapInArrow(_hash_rows, "h binary"), filter_bits(2 * sum(sizes.values()))) if recent else None)
        found = blocks.where(F.col("turn") == step % shards).mapInArrow(_scan(step < shards, held, recent, longest, pieces), COUNTS)
        summed = found.repartition(tasks, "piece").sortWithinPartitions("piece", "lang", "k").mapInArrow(_add_up, COUNTS)
        counted.append(materialise(summed, "counts"))
        held.destroy()
        # Whatever reaches the threshold within a cycle has a share of it in one of its steps.
        window = range(max(0, step - shards + 1), step + 1)
        heavy = together([counted[u] for u in window]).mapInArrow(_hash_counted(-(-threshold // shards)), "h binary")
        among = spark.sparkContext.broadcast(build_filter(heavy, filter_bits(every // HEAVY_WORDS)))
        hits = together([counted[u].mapInArrow(_select(among), ROWS).withColumn("step", F.lit(u)) for u in window])
        side = F.broadcast if sum(sizes.values()) <= BROADCAST_PHRASES else lambda df: df
        now = _in_own_cycle(hits, reached, shards, side).where(F.col("n") >= threshold).join(side(reached.select("lang", "phrase")), ["lang", "phrase"], "left_anti")
        reached = materialise(reached.unionByName(now.select("lang", "k", "phrase", F.lit(step).alias("reach"))), "reached")
        among.destroy()
        sizes = {(row["k"], row["reach"]): row["count"] for row in reached.groupBy("k", "reach").count().collect()}  # at most one row a length and step
        last = max([last, *(at + shards for k, at in sizes if k < longest)])
        step += 1
    marked = reached.select("lang", "phrase", F.lit(False).alias("recent")).mapInArrow(_hash_rows, "h binary")
    among = spark.sparkContext.broadcast(build_filter(marked, filter_bits(sum(sizes.values()))))
    hits = together([c.mapInArrow(_select(among), ROWS).withColumn("step", F.lit(u)) for u, c in enumerate(counted)])
    out = materialise(_in_own_cycle(hits, reached, shards).join(reached.select("lang", "phrase"), ["lang", "phrase"], "left_semi"), "phrases")
    among.destroy()
    return out, totals


def _words(phrase: str, first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, size), " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS, top: int = TOP, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The best ``top`` phrases of two words and more of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase found a times is cut where its score floor(2000000 a / (l + r)) is lowest (ties: the first cut),
    l and r being the counts of the two parts. Phrases that a longer candidate holds at least 80 % as often
    are dropped. Ranked by score and count, both falling, then by phrase in byte order. n: words of the language.

    Words are lower-cased (A-Z), parted by blanks and tabs; phrases end at [.,;:!?] and at line breaks. NULL
    texts count as empty, a NULL lang as ``und``. Repeated rows are counted each; no key is read. Languages
    without a phrase give no rows, nor does an empty table; other columns are ignored.
    """
    counts, totals = frequent_phrases(docs, text, lang, threshold, longest, shards, block_bytes)
    found = counts.where("k > 1")
    cuts = found.select("lang", "k", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": _words("phrase", 1, F.col("cut")), "right": _words("phrase", F.col("cut") + 1, F.col("k") - F.col("cut"))})
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(30,0)")
    cuts = cuts.withColumns({"_top": (wide("a") * F.lit(SCALE)).cast("decimal(38,0)"), "_sum": (wide("l") + wide("r")).cast("decimal(38,0)")}).withColumn("score", F.expr("_top div _sum"))
    best = cuts.groupBy("lang", "k", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("x"))
    # Parts of a longer candidate, with the largest count of a candidate that holds them.
    longer = found.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    held = longer.select("lang", _words("phrase", F.col("at"), F.col("size")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("_most"))
    kept = best.join(held, ["lang", "phrase"], "left").where(F.col("_most").isNull() | (wide("_most") * 100 < wide("a") * CONTAINED_PERCENT))
    order = Window.partitionBy("lang").orderBy(F.col("x.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = ranked.join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").cast("long").alias("score"))
