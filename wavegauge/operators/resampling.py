"""Row bootstraps of ranking metrics without one row per draw.

Rows of the same score and label are interchangeable, so a replicate is a vector of counts over the
distinct (score, label) steps. A key's steps are cut into blocks of neighbouring scores. First the
draws of every replicate are dealt to the blocks (multinomial in the block sizes, which are a few
numbers), then each block draws its own counts and adds its share of the average precision, from
the draws that fall above it. Steps are shuffled once for each slice of replicates, draws never.

Draws are a fixed function of replicate, label, block and draw number, so a task that is run again
gives the same counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scale import largest_group, null_safe_join, place_among

# Rows of a key that are drawn from as one block; larger keys are cut at approximate quantiles.
BLOCK_ROWS = 1 << 16
MOST_CUTS = 4096
# Replicates are dealt to this many tasks for each block.
SLICES = 4
# Draws that are generated at a time.
CHUNK = 1 << 20

# Odd multipliers of the 32-bit mixing function, and the step from one draw to the next.
MIX_A, MIX_B, STEP = 0x7FEB352D, 0x846CA68B, 0x9E3779B9
_LOW = np.uint64(0xFFFFFFFF)


def mix32(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 32-bit numbers held in unsigned 64-bit ones."""
    h = (h ^ (h >> np.uint64(16))) * np.uint64(MIX_A) & _LOW
    h = (h ^ (h >> np.uint64(15))) * np.uint64(MIX_B) & _LOW
    return h ^ (h >> np.uint64(16))


def draws(rep: int, stratum: int, block: int, n: int):
    """``n`` 32-bit numbers of a replicate, stratum and block, a chunk at a time."""
    seed = mix32(mix32(np.array([(rep * 4 + stratum + 1) & 0xFFFFFFFF], np.uint64)) ^ np.uint64(block))
    for lo in range(0, n, CHUNK):
        i = np.arange(lo, min(lo + CHUNK, n), dtype=np.uint64)
        yield mix32((seed + (i & _LOW) * np.uint64(STEP)) & _LOW)


def step_counts(counts: np.ndarray, rep: int, stratum: int, block: int, n: int) -> np.ndarray:
    """How often each step is picked in ``n`` draws from all their rows."""
    if n == 0 or len(counts) < 2:
        return np.full(len(counts), n, np.int64)
    total = int(counts.sum())
    step = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(len(counts), np.int64)
    for h in draws(rep, stratum, block, n):
        out += np.bincount(step[(h * np.uint64(total)) >> np.uint64(32)], minlength=len(counts))
    return out


def _deal(rep: int, stratum: int, sizes: np.ndarray, n: int) -> np.ndarray:
    """Draws that fall into each block."""
    held = np.flatnonzero(sizes)
    out = np.zeros(len(sizes), np.int64)
    if len(held) > 1:
        share = sizes[held] / sizes.sum()
        out[held] = np.random.Generator(np.random.Philox(key=[rep, stratum])).multinomial(n, share)
    else:
        out[held] = n
    return out


def _deal_slice(reps: int, stratify: bool):
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_b", ascending=False)
        pos, neg = b["pos"].to_numpy(np.int64), b["neg"].to_numpy(np.int64)
        p, n = int(pos.sum()), int(pos.sum() + neg.sum())
        own = range(int(b["_slice"].iloc[0]), reps, SLICES)
        m1, m0 = np.zeros((len(b), len(own)), np.int64), np.zeros((len(b), len(own)), np.int64)
        for j, rep in enumerate(own):
            take = p if stratify else sum(int((h < p / n * 4294967296.0).sum()) for h in draws(rep, 2, 0, n))
            m1[:, j], m0[:, j] = _deal(rep, 1, pos, take), _deal(rep, 0, neg, n - take)
        above1, above0 = np.cumsum(m1, 0) - m1, np.cumsum(m0, 0) - m0
        return pd.DataFrame(
            {"_k": b["_k"].to_numpy(), "_b": b["_b"].to_numpy(), "_slice": b["_slice"].to_numpy(), "m1": list(m1), "m0": list(m0), "above1": list(above1), "above0": list(above0)}
        )

    return run


def _block_share(reps: int):
    def run(steps: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        key, block, first = dealt["_k"].iloc[0], int(dealt["_b"].iloc[0]), int(dealt["_slice"].iloc[0])
        steps = steps.sort_values("_s")
        p, q = steps["pos"].to_numpy(np.int64), steps["neg"].to_numpy(np.int64)
        at1, at0 = np.flatnonzero(p), np.flatnonzero(q)
        m1, m0, above1, above0 = (dealt[c].iloc[0] for c in ("m1", "m0", "above1", "above0"))
        own = range(first, reps, SLICES)
        part = np.zeros(len(own))
        for j, rep in enumerate(own):
            w1, w0 = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            w1[at1] = step_counts(p[at1], rep, 1, block, int(m1[j]))
            w0[at0] = step_counts(q[at0], rep, 0, block, int(m0[j]))
            w1, w0 = w1[::-1], w0[::-1]
            above = above1[j] + np.cumsum(w1)
            total = above + above0[j] + np.cumsum(w0)
            hit = w1 > 0
            part[j] = (w1[hit] * (above[hit] / total[hit])).sum()
        return pd.DataFrame({"_k": key, "rep": list(own), "part": part, "m1": np.asarray(m1), "m0": np.asarray(m0)})

    return run


def _blocks(d: DataFrame, steps: DataFrame, block_rows: int) -> DataFrame:
    """Number the score blocks (``_b``, ascending). A cut value is a block of its own, so a score that
    many rows share costs no draws."""
    most = largest_group(d, ["_k"])
    if most <= block_rows:
        return steps.withColumn("_b", F.lit(0).cast("long"))
    n = 2
    while n < MOST_CUTS and n * block_rows < most:
        n *= 2
    cuts = d.groupBy("_k").agg(F.percentile_approx("_s", [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("_cuts"))
    own = F.array_contains("_cuts", F.col("_s")).cast("long")
    placed = steps.join(cuts, "_k").withColumn("_b", 2 * place_among("_s", F.col("_cuts"), n).cast("long") + own)
    return placed.drop("_cuts")


def replicate_ap(df: DataFrame, keys: list[str], score: str, label: str, reps: int, stratify: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Average precision of every bootstrap replicate: keys, rep, ap (NULL where a class is absent).

    With ``stratify`` a replicate has as many rows of each label as the source, otherwise only as
    many rows. Rows without score or label take no part; NULL keys form their own group; an empty
    table gives no rows.
    """
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *keys, F.col(score).cast("double").alias("_s"), F.col(label).cast("int").alias("_y"),
        (F.to_json(F.struct(*keys)) if keys else F.lit("")).alias("_k"),
    )
    steps = d.groupBy("_k", "_s").agg(F.sum("_y").cast("long").alias("pos"), F.sum(1 - F.col("_y")).cast("long").alias("neg"))
    steps = _blocks(d, steps, block_rows).withColumn("_slice", F.explode(F.array(*[F.lit(s) for s in range(min(SLICES, reps))])))
    dealt = (
        steps.groupBy("_k", "_b", "_slice").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .groupBy("_k", "_slice")
        .applyInPandas(_deal_slice(reps, stratify), "_k string, _b long, _slice int, m1 array<long>, m0 array<long>, above1 array<long>, above0 array<long>")
    )
    own = ["_k", "_b", "_slice"]
    shares = steps.groupBy(*own).cogroup(dealt.groupBy(*own)).applyInPandas(_block_share(reps), "_k string, rep int, part double, m1 long, m0 long")
    out = shares.groupBy("_k", "rep").agg(F.sum("part").alias("_p"), F.sum("m1").alias("_m1"), F.sum("m0").alias("_m0"))
    both = (F.col("_m1") > 0) & (F.col("_m0") > 0)
    out = out.select("_k", "rep", F.when(both, F.col("_p") / F.col("_m1")).alias("ap"))
    return out.join(d.select("_k", *keys).distinct(), "_k").select(*keys, "rep", "ap")


# Draws whose key ends in the same leading digits are hashed together.
HASHED = 10_000
_DIGITS = np.frombuffer(b"".join(b"%04d" % i for i in range(HASHED)), np.uint8).reshape(HASHED, 4)
_SHIFTS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
# Distinct (key, side, value) steps that every task may hold, and tasks among which replicates are dealt.
SHARED_STEPS, REPLICATE_TASKS = 2_000_000, 256


def md5_heads(prefix: bytes, block: int, most: int = HASHED) -> np.ndarray:
    """First 32 bits of the MD5 of ``prefix`` and a decimal number, for the first ``most`` of the ``HASHED``
    numbers of a block.

    The keys of a block differ in their last four digits only, so they are hashed in step.
    """
    head = prefix + (b"%d" % block if block else b"")
    size = len(head) + 4
    one_by_one = lambda lo, hi: np.frombuffer(b"".join(hashlib.md5(prefix + b"%d" % j).digest()[:4] for j in range(lo, hi)), ">u4").astype(np.uint32)
    if size > 55 or most <= 1000:  # more than one MD5 block, or too few
        return one_by_one(block * HASHED, block * HASHED + most)
    padded = np.frombuffer(head + bytes(4) + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little"), np.uint8)
    words = list(padded.view("<u4"))
    first, last = len(head) // 4, (size - 1) // 4
    own = np.tile(padded[4 * first : 4 * last + 4], (HASHED, 1))
    own[:, len(head) - 4 * first : size - 4 * first] = _DIGITS
    for k, w in zip(range(first, last + 1), own.view("<u4").T):
        words[k] = np.ascontiguousarray(w)
    a, b, c, d = (np.full(HASHED, x, np.uint32) for x in _START)
    f, t = np.empty(HASHED, np.uint32), np.empty(HASHED, np.uint32)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        if words[g].ndim:
            f += words[g]
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((int(words[g]) + _SINES[i]) & 0xFFFFFFFF)
        s = _SHIFTS[kind][i % 4]
        np.right_shift(f, np.uint32(32 - s), out=t)
        f <<= np.uint32(s)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    out = (a + np.uint32(_START[0])).byteswap()
    if not block:
        out[:1000] = one_by_one(0, 1000)  # numbers of fewer digits
    return out[:most]


def _picks(prefix: bytes, ends: np.ndarray, draws_: int) -> np.ndarray:
    """How often each step is picked; ``ends`` are the running row counts of the steps."""
    out = np.zeros(len(ends), np.int64)
    n, held, waiting = int(ends[-1]), [], 0
    blocks = -(-draws_ // HASHED)
    for block in range(blocks):
        h = md5_heads(prefix, block, min(HASHED, draws_ - block * HASHED))
        held.append(np.searchsorted(ends, h.astype(np.int64) % n, "right"))
        waiting += len(h)
        if waiting >= len(ends) or block == blocks - 1:
            out += np.bincount(np.concatenate(held), minlength=len(ends))
            held, waiting = [], 0
    return out


def replicate_ks(steps: DataFrame, keys: list[str], reps: int, salt: Column, draw_cap: int | None = None, min_rows: int = 10) -> DataFrame:
    """Kolmogorov-Smirnov distance of every replicate: keys, rep, ks (NULL where a side draws fewer than ``min_rows``).

    ``steps`` has keys, _side (0 or 1), _v and n, its row count; the caller has counted them to be at most
    ``SHARED_STEPS``. They are shared with the tasks, each of which makes whole replicates: a draw is the
    row at position md5(rep|salt|number) of its side, and only counts by step are kept.
    """
    spark = steps.sparkSession
    named = steps.withColumn("_k", F.to_json(F.struct(*keys)) if keys else F.lit("")).withColumn("_salt", salt)
    table = named.select("_k", "_salt", "_side", "_v", "n").toPandas()  # counted by the caller
    names = sorted(set(table["_k"]))
    if not names:
        return steps.select(*keys, F.lit(0).alias("rep"), F.lit(None).cast("double").alias("ks")).limit(0)
    sides = {k: (part["_salt"].iloc[0], part["_v"].to_numpy(float), np.cumsum(part["n"].to_numpy(np.int64))) for k, part in table.sort_values("_v").groupby(["_k", "_side"])}
    shared = spark.sparkContext.broadcast(sides)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for unit in b["id"].tolist():
                k, rep = names[unit % len(names)], unit // len(names)
                both = [shared.value.get((k, side)) for side in (1, 0)]
                finite = [x[1][np.isfinite(x[1])] if x else np.zeros(0) for x in both]
                at, share = np.union1d(*finite), []
                for x, v in zip(both, finite):
                    if x:
                        m = int(x[2][-1]) if draw_cap is None else min(int(x[2][-1]), draw_cap)
                        w = np.zeros(len(at), np.int64)
                        w[np.searchsorted(at, v)] = _picks(f"{rep}|{x[0]}|".encode(), x[2], m)[np.isfinite(x[1])]
                        if w.sum() >= min_rows:
                            share.append(np.cumsum(w) / w.sum())
                out.append((k, rep, float(np.abs(share[0] - share[1]).max()) if len(share) == 2 else None))
            yield pd.DataFrame(out, columns=["_k", "rep", "ks"]).astype({"ks": float})

    units = len(names) * reps
    out = spark.range(0, units, 1, min(units, REPLICATE_TASKS)).mapInPandas(run, "_k string, rep int, ks double")
    out = out.withColumn("ks", F.when(~F.isnan("ks"), F.col("ks")))
    return out.join(named.select("_k", *keys).distinct(), "_k").select(*keys, "rep", "ks")
