"""Small DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(df: DataFrame) -> int:
    """Shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def group_tables(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Whole groups of a partition sorted by ``by``, several at once, numbered in column ``group``."""
    held: list[pa.RecordBatch] = []
    count = 0

    def numbered(t: pa.Table) -> pa.Table:
        keys = [np.asarray(t[c]) for c in by]
        new = np.zeros(len(t), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return t.append_column("group", pa.array(np.cumsum(new)))

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count >= rows:
            t = numbered(pa.Table.from_batches(held))
            group = np.asarray(t["group"])
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield t.slice(0, cut)
            rest = t.slice(cut).drop_columns(["group"]).combine_chunks()
            held = rest.to_batches()
            count = 0
    if held:
        yield numbered(pa.Table.from_batches(held))


def block_pairs(df: DataFrame, row: str, blocks: str) -> DataFrame:
    """Rows once for each pair of blocks in which they meet rows of their group.

    ``blocks`` is the size of the row's group in blocks. Groups of one block stay whole (pair 0);
    otherwise a row falls into a block by its id (column ``blk``) and column ``pair`` numbers the pairs.
    """
    n = F.greatest(F.ceil(F.col(blocks)), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64(row), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda o: (F.least(o, mine) * n + F.greatest(o, mine)).cast("int"))
    return df.withColumn("blk", mine).withColumn("pair", F.explode(pairs))
