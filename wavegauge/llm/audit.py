"""Filter interaction audit over a sparse document-term matrix.

1. Every task turns its texts into shards of a document-term matrix: rows of word counts over the
   shard's own vocabulary, and the shard's different texts by digest.
2. The vocabularies of all shards meet by word in a global dictionary; each shard gets the global
   numbers of its words, and likewise the smallest document that holds each of its texts.
3. Row sums and nonzero counts of the matrix decide filters A and B; C and D are flags of the text and
   E compares a row's document with the first one that holds the same text.
4. Documents are counted by part, pattern of failed filters and labels; every order of the filters is
   read off these counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .frames import parallelism
from .repetition import word_codes
from .text import SPACE, byte_hashes, slices, words

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_UPPER_PERCENT = 10
# Characters whose presence fails filter D.
SYMBOLS = "#$%&*|"
# Text of a shard in bytes; a longer text is a shard of its own.
SHARD_BYTES = 1 << 21
# Different words that are numbered together, about; one word in so many is counted to size the dictionary.
DICTIONARY_SLICE = 1 << 19
COUNT_ONE_IN = 1024


def pack_words(strings: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words (which hold no line feed) by hash, each followed by one; their hashes, and where each was."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
    data = np.append(np.frombuffer(strings.buffers()[2], np.uint8)[: offsets[-1]], np.zeros(8, np.uint8)) if len(strings) else np.zeros(8, np.uint8)
    length = np.diff(offsets)
    hashes = byte_hashes(data, offsets[:-1], length)
    by = np.argsort(hashes, kind="stable")
    ends = np.cumsum(length[by] + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 10, np.uint8)
    to = np.arange(int(length.sum())) + np.repeat(np.arange(len(by)), length[by])
    out[to] = data[np.repeat(offsets[:-1][by] - np.cumsum(length[by]) + length[by], length[by]) + np.arange(len(to))]
    return out.tobytes(), hashes[by], by


def unpack_words(packed: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of ``pack_words`` and the place of each word's end in it."""
    raw = np.frombuffer(packed, np.uint8)
    ends = np.flatnonzero(raw == 10) + 1
    offsets = np.concatenate(([0], ends - np.arange(1, len(ends) + 1))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[raw != 10])]), ends


def _shards(kind: pa.DataType):
    """Shards over their own vocabulary: rows of counts, flags of the texts, and different texts by digest."""
    symbol, upper = np.zeros(256, bool), np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    upper[65:91] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b.column("text"), SHARD_BYTES):
                data, start, length, first = words(t, lower=False)
                code, vocabulary = word_codes(data, start, length, whole=~SPACE)
                packed, hashes, by = pack_words(vocabulary)
                number = np.empty(len(by), np.int64)
                number[by] = np.arange(len(by))
                row = np.repeat(np.arange(t.count), np.diff(first))
                width = max(len(by), 1)
                cell, count = np.unique(row * width + number[code], return_counts=True)
                body = t.data[:-8]
                total = lambda member: np.diff(np.concatenate(([0], np.cumsum(member, dtype=np.int32)))[t.start]).astype(np.int64)
                flag_c = 100 * total(upper[body]) > MAX_UPPER_PERCENT * total((body & 0xC0) != 0x80)
                flag_d = total(symbol[body]) > 0
                digests = [hashlib.sha256(body[lo:hi]).digest() for lo, hi in zip(t.start[:-1], t.start[1:])]
                texts = pa.array(digests, pa.binary()).dictionary_encode()
                ids = b.column("doc_id").slice(t.first, t.count)
                least = pa.table({"text": texts.indices, "doc_id": ids}).group_by("text").aggregate([("doc_id", "min")]).sort_by("text")
                few = hashes[hashes % np.uint64(COUNT_ONE_IN) == 0].astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_ids": _one(ids),
                        "parts": _one(b.column("part").slice(t.first, t.count)),
                        "row_ends": [np.searchsorted(cell, (np.arange(t.count) + 1) * width).astype(np.int64).tobytes()],
                        "columns": [(cell % width).astype(np.int32).tobytes()],
                        "counts": [count.astype(np.int32).tobytes()],
                        "flags": [(flag_c + 2 * flag_d).astype(np.int8).tobytes()],
                        "text_of": [np.asarray(texts.indices).astype(np.int32).tobytes()],
                        "texts": _one(texts.dictionary),
                        "holders": _one(least["doc_id_min"].combine_chunks().cast(kind)),
                        "few": _one(pa.array(few)),
                        "vocabulary": [packed],
                    }
                )

    return run


def _one(values: pa.Array) -> pa.ListArray:
    """One row that holds all the values as a list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _fragments(n: int):
    """The words of a shard by slice of the dictionary (a range of hashes), so that a slice's words lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, packed in zip(b.column("shard"), b.column("vocabulary")):
                packed = packed.as_py()
                strings, ends = unpack_words(packed)
                _, hashes, _ = pack_words(strings)
                piece = ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
                have, at = np.unique(piece, return_index=True)
                cut = np.concatenate((np.append(0, ends)[at], [len(packed)]))
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array([shard.as_py()] * len(have), pa.int64()), "piece": have.astype(np.int32), "words": pa.array([packed[lo:hi] for lo, hi in zip(cut[:-1], cut[1:])], pa.binary())}
                )

    return run


def _number(n: int):
    """Global numbers of the words of every fragment; fragments come slice by slice, by shard in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, pa.array([], pa.large_binary())
        for b in batches:
            pieces = np.asarray(b.column("piece"))
            edges = np.flatnonzero(np.diff(pieces)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(pieces)]):
                if hi == lo:
                    continue
                if pieces[lo] != at:
                    at, known = int(pieces[lo]), pa.array([], pa.large_binary())
                each = [unpack_words(x.as_py())[0] for x in b.column("words").slice(lo, hi - lo)]
                coded = pa.concat_arrays([known, *each]).dictionary_encode()
                ids = np.asarray(coded.indices)[len(known) :].astype(np.int64) * n + at
                known = coded.dictionary
                cut = np.concatenate(([0], np.cumsum([len(x) for x in each])))
                yield pa.RecordBatch.from_arrays(
                    [b.column("shard").slice(lo, hi - lo), b.column("piece").slice(lo, hi - lo), pa.array([ids[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())], ["shard", "piece", "ids"]
                )

    return run


def _encode(kind: pa.DataType):
    """Shards over the global dictionary, with the first holder of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                array = lambda c, of: np.frombuffer(b.column(c)[i].as_py(), of)
                ends = array("row_ends", np.int64)
                ids = np.frombuffer(b"".join(b.column("ids")[i].as_py() or []), np.int64)
                columns = ids[array("columns", np.int32)]
                row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                by = np.lexsort((columns, row))  # columns of a row in the order of the global numbers
                firsts = b.column("firsts")[i].values.take(pa.array(array("text_of", np.int32)))
                new = {"columns": pa.array([columns[by].tobytes()]), "counts": pa.array([array("counts", np.int32)[by].tobytes()]), "firsts": _one(firsts.cast(kind))}
                names = ["shard", "doc_ids", "parts", "row_ends", "columns", "counts", "flags", "firsts"]
                yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c).slice(i, 1) for c in names], names)

    return run


def document_term_matrix(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str | None = None) -> DataFrame:
    """See ``_matrix``: the shards as rows."""
    return _matrix(docs, key, text, part)


def _matrix(docs: DataFrame, key: str, text: str, part: str | None, then=None, schema: str = "") -> DataFrame:
    """Shards of the sparse matrix of word counts, compressed by rows, over one global dictionary.

    One row a shard: doc_ids and parts of its documents, row_ends (end of each document's entries), columns
    (global word numbers, ascending in a row) and counts of the entries, flags of the texts (1: too many
    capitals, 2: a symbol) and firsts (the smallest doc_id with the same text). Numbers are little-endian
    arrays in a binary value: row_ends and columns of 64 bits, counts of 32, flags of 8. Words are
    ``[^\\x20\\x09-\\x0D]+``, case-sensitive. Shards hold whole texts of about 2 MB in all.

    ``then`` reads the finished shards in the process that makes them (``schema`` is what it yields): a second
    process a task, and shards that pass through the JVM between the two, would cost as much memory again.
    """
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.coalesce(F.col(part), F.lit("")) if part else F.lit("")).alias("part"))
    kind = base.schema["doc_id"].dataType.simpleString()
    arrow = base.limit(0).select("doc_id").toArrow().schema.field("doc_id").type
    lists = f"doc_ids array<{kind}>, parts array<string>, row_ends binary, columns binary, counts binary, flags binary"
    local = base.mapInArrow(_shards(arrow), f"{lists}, text_of binary, texts array<binary>, holders array<{kind}>, few array<long>, vocabulary binary")
    # The number of a shard is fixed by the table that is written, not by the task that made it.
    local = materialise(local.withColumn("shard", F.monotonically_increasing_id()), "shards")

    sampled = local.select(F.explode("few").alias("h")).distinct().count()  # sizes the dictionary only
    tasks = parallelism(docs)
    n = max(tasks, -(-sampled * COUNT_ONE_IN // DICTIONARY_SLICE))
    fragments = local.select("shard", "vocabulary").mapInArrow(_fragments(n), "shard long, piece int, words binary")
    numbered = fragments.repartition(tasks, "piece").sortWithinPartitions("piece", "shard").mapInArrow(_number(n), "shard long, piece int, ids binary")
    held = local.select("shard", F.posexplode(F.arrays_zip("texts", "holders")).alias("at", "t")).select("shard", "at", F.col("t.texts").alias("digest"), F.col("t.holders").alias("holder"))
    least = held.groupBy("digest").agg(F.min("holder").alias("first"))
    # Of a shard: as many rows as it has slices, and as many as it has different texts.
    ids = numbered.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("x")).select("shard", F.col("x.ids").alias("ids"))
    firsts = held.join(least, "digest").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("at", "first"))).alias("x")).select("shard", F.col("x.first").alias("firsts"))
    rows = local.drop("texts", "holders", "few", "vocabulary").join(firsts, "shard").join(ids, "shard", "left")
    encode = _encode(arrow)
    if then is None:
        return rows.mapInArrow(encode, f"shard long, {lists}, firsts array<{kind}>")
    return rows.mapInArrow(lambda batches: then(encode(batches)), schema)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a document: row sum, nonzero count, flags and first holder of its text."""
    for b in batches:
        for i in range(b.num_rows):
            array = lambda c, of: np.frombuffer(b.column(c)[i].as_py(), of)
            ends = array("row_ends", np.int64)
            running = np.concatenate(([0], np.cumsum(array("counts", np.int32), dtype=np.int64)))
            starts = np.concatenate(([0], ends[:-1]))
            values = [b.column(c)[i].values for c in ("doc_ids", "parts", "firsts")]
            yield pa.RecordBatch.from_arrays(
                [values[0], values[1], pa.array(running[ends] - running[starts]), pa.array(ends - starts), pa.array(array("flags", np.int8)), values[2]],
                ["doc_id", "part", "n_words", "n_distinct", "flags", "first"],
            )


def failed_filters(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, n_words, n_distinct, mask) for every row; bit i of ``mask``: the row fails filter i of ABCDE.

    A: under 100 words; B: under 80 % of the words differ; C: over 10 % of the code points are A-Z; D: holds
    a symbol; E: some smaller doc_id has the identical text. NULL texts count as empty (they fail A, and E
    after the first), NULL parts as the empty string. Rows without doc_id are in no order: they never fail
    E and make no other row fail it. Rows with one doc_id are judged each; equal doc_ids do not fail E.
    """
    kind = docs.schema[key].dataType.simpleString()
    d = _matrix(docs, key, text, part, _rows_of, f"doc_id {kind}, part string, n_words long, n_distinct long, flags tinyint, first {kind}")
    fails = [
        F.col("n_words") < MIN_WORDS,
        100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"),
        F.col("flags").bitwiseAND(F.lit(1).cast("tinyint")) > 0,
        F.col("flags").bitwiseAND(F.lit(2).cast("tinyint")) > 0,
        F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)),
    ]
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails)), F.lit(0))
    return d.select("doc_id", "part", "n_words", "n_distinct", mask.alias("mask"))


def _orders() -> Column:
    """Every order of the filters with its steps: (filter_order, step, before, own), the latter two as bits."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        for step, own in enumerate(order):
            before = sum(1 << i for i in order[:step])
            out.append(f"named_struct('filter_order', '{name}', 'step', {step + 1}, 'before', {before}, 'own', {1 << own})")
    return F.expr(f"array({', '.join(out)})")


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What every filter removes at every step of every order, per part.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley (long), zeros included. ``labels`` (doc_id, quality, toxic) may lack documents or hold several
    rows of one: a document is good, or toxic, if any of its rows says 1. NULL labels say nothing. Rows of
    ``docs`` are counted each, also those without doc_id, which have no labels. An empty table gives no
    rows; other columns are ignored. See ``failed_filters`` for the conditions.
    """
    rows = failed_filters(docs, key, text, part)
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    n = rows.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    packed = n.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # at most 32 patterns
    each = packed.withColumn("o", F.explode(_orders())).select("part", "m", "o.*")

    def total(value: str, where) -> Column:
        return F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.when(where(x["mask"]), x[value]).otherwise(F.lit(0).cast("long")))

    clear = lambda m, bits: m.bitwiseAND(bits) == 0
    before, own = F.col("before"), F.col("own")
    here = lambda m: clear(m, before) & ~clear(m, own)
    share = F.array(F.lit(0).cast("long"), *[F.lit(120 // size).cast("long") for size in range(1, 6)])  # orders in which one of ``size`` filters comes first
    return each.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        total("n", lambda m: clear(m, before.bitwiseOR(own))).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: ~clear(m, own) & ~clear(m, before)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.when(~clear(x["mask"], own), x["n"] * F.element_at(share, F.bit_count(x["mask"]) + 1)).otherwise(F.lit(0).cast("long"))).alias("shapley"),
    )
