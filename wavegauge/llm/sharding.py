"""Jump consistent hashing: a shard for every key, computed without a table of the ring.

The walk of Lamping and Veach jumps from shard to shard; a key ends at the last landing point below
the number of shards. Its random numbers come from a Lehmer generator (modulus 2^31 - 1, factor
48271) seeded by the key's MD5, so a step fits a signed 64-bit product and other engines can repeat
it. With one more shard a key either stays or moves into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS, FACTOR = 2_147_483_647, 48_271
# Slices by which the rows of a shard are numbered; a slice holds about 1 / (shards * SLICES) of all rows.
SLICES = 1024


def _hex(key: Column, first: int) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), first, 8), 16, 10).cast("long")


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a key by jump consistent hashing; NULL counts as an empty key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(s: Column, _: Column) -> Column:
        k = (s["k"] * FACTOR) % MODULUS
        j = F.floor((s["j"] + 1) * F.lit(float(MODULUS)) / k).cast("long")
        on = s["j"] < shards
        return F.struct(F.when(on, s["j"]).otherwise(s["b"]).alias("b"), F.when(on, j).otherwise(s["j"]).alias("j"), k.alias("k"))

    seed = _hex(key, 1) % (MODULUS - 1) + 1
    begin = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), seed.alias("k"))
    # Every step moves j up by one at least, so shards + 1 steps end the walk.
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), begin, step, lambda s: s["b"]).cast("int")


def slice_of(key: Column, slices: int = SLICES) -> Column:
    """A slice of the keys, independent of the shard."""
    return (_hex(key, 9) % slices).cast("int")


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", slices: int = SLICES) -> DataFrame:
    """Shard, slot and size of every row, and its shard if one more were appended.

    Law ``key``: the key and the number of shards decide. Size is the UTF-8 bytes of the text plus 8
    (NULL text: 8, checksum 0 as of an empty text). Slots count from 0 without gaps within a shard,
    by slice and key; a slice is numbered at a time, from the counts of the slices before it, so no
    task orders a whole shard. Equal keys share shard and slice and get slots one after another.
    NULL keys form one key. An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    from pyspark.sql import Window

    base = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        jump_shard(F.col(key), shards).alias("shard"),
        slice_of(F.col(key), slices).alias("slice"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    counts = docs.groupBy(jump_shard(F.col(key), shards).alias("shard"), slice_of(F.col(key), slices).alias("slice")).count()
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * slices rows, whatever the input: safe to broadcast.
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "slice").orderBy("doc_id", "text_crc32", "size")
    return (
        base.withColumn("rank", F.row_number().over(own) - 1)
        .join(F.broadcast(offsets), ["shard", "slice"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
    )
