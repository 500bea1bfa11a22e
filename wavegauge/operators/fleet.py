"""Fleet-level series of a recorded drive-test segment, their scorer and plausibility checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .control import cell_transitions
from .ranking import thresholds

DISCLAIMER = "no ground-truth labels available"
FLEET = ["rsrp_mean", "sinr_mean", "ho_rate", "n_cells"]


# Grid points of a segment that are made at a time.
GRID_BLOCK = 4096


def _with_row(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the one row of its segment; without keys there is one segment and one such row."""
    return df.join(per_key, keys) if keys else df.crossJoin(F.broadcast(per_key))


def fleet_streams(
    df: DataFrame, bucket_s: float = 1.0, ho_window_s: float = 60.0, max_gap: float = 60.0, tie: str = "time_s", chunk: float = 86_400.0, keys: list[str] | None = None
) -> DataFrame:
    """Bucket means, distinct cells, sample counts, centred transition rate and hour of day.

    With ``keys`` (operator_id, ran_type or both) every segment has a series of its own, from its first
    to its last sample; rows without a key belong to no segment. Otherwise the table is one segment.
    """
    keys = list(keys or [])
    df = df.dropna(subset=keys) if keys else df
    ends = df.groupBy(*keys).agg(F.min("time_s").cast("double").alias("_t0"), F.max("time_s").cast("double").alias("_t1"))
    ends = ends.withColumn("_n", F.ceil((F.col("_t1") - F.col("_t0") + 1e-9) / F.lit(float(bucket_s)))).drop("_t1")
    if ends.where("_t0 is not null").isEmpty():
        raise ValueError("no rows to resample")
    place = F.least(F.floor((F.col("time_s") - F.col("_t0")) / F.lit(float(bucket_s))), F.col("_n") - 1)
    agg = _with_row(df, ends, keys).groupBy(*keys, place.alias("i")).agg(
        F.avg("rsrp_serving_dbm").alias("rsrp_mean"),
        F.avg("sinr_serving_db").alias("sinr_mean"),
        F.countDistinct("serving_cell_id").alias("n_cells"),
        F.count(F.lit(1)).alias("n_samples"),
    )
    w = max(1, int(round(ho_window_s / bucket_s)))
    moves = _with_row(cell_transitions(df, max_gap, chunk, tie), ends, keys).groupBy(*keys, place.alias("_j")).agg(F.count(F.lit(1)).alias("_m"))
    # A bucket counts for every centre whose window covers it; no ordering of the series is needed.
    ahead, behind = (w - 1) // 2, w - 1 - (w - 1) // 2
    spread = moves.withColumn("i", F.explode(F.sequence(F.col("_j") - ahead, F.col("_j") + behind)))
    rate = spread.groupBy(*keys, "i").agg((F.sum("_m") / F.lit(float(ho_window_s))).alias("ho_rate"))
    # The grid is made in two steps, so that no task makes that of a long segment alone.
    first = F.col("_blk") * GRID_BLOCK
    blocks = ends.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / GRID_BLOCK)))).repartition(*keys, "_blk")
    t = F.col("i") * F.lit(float(bucket_s))
    grid = blocks.withColumn("i", F.explode(F.sequence(first, F.least(first + GRID_BLOCK, F.col("_n")) - 1))).select(
        *keys, "i", t.alias("t_s"), F.floor((F.col("_t0") + t) / 3600 % 24).cast("int").alias("hour")
    )
    out = grid.join(agg, [*keys, "i"], "left").join(rate, [*keys, "i"], "left")
    return out.fillna(0, ["n_cells", "n_samples"]).fillna(0.0, ["ho_rate"])


def fleet_windows(streams: DataFrame, bucket_s: float = 1.0, window_s: float = 30.0, slide_s: float = 5.0, keys: list[str] | None = None) -> DataFrame:
    """Mean and deviation of the four series per segment and sliding window; empty signal windows count as 0."""
    keys = list(keys or [])
    w, s = max(1, int(round(window_s / bucket_s))), max(1, int(round(slide_s / bucket_s)))
    last = streams.groupBy(*keys).agg(F.floor(F.greatest(F.max("i") + 1 - w, F.lit(0)) / s).alias("_last"))
    k_hi = F.least(F.floor(F.col("i") / s), F.col("_last"))
    k_lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") - w + 1) / s))
    d = _with_row(streams, last, keys).where(k_hi >= k_lo).withColumn("k", F.explode(F.sequence(k_lo, k_hi)))
    feats = []
    for c in FLEET:
        feats += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}__mean"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(f"{c}__std")]
    return d.groupBy(*keys, "k").agg(*feats).withColumn("t_center_s", F.col("k") * F.lit(float(s * bucket_s)) + F.lit(window_s / 2))


def _principal(keys: list[str], d: int, components: int):
    """Mean and leading directions of each segment from its sums of values and of products."""
    pairs = [(a, b) for a in range(d) for b in range(a, d)]

    def run(batches):
        for rows in batches:
            means, bases = [], []
            for r in rows.itertuples(index=False):
                mean = np.array([getattr(r, f"s{a}") for a in range(d)]) / r.n
                cov = np.zeros((d, d))
                for a, b in pairs:
                    cov[a, b] = cov[b, a] = getattr(r, f"g{a}x{b}") / r.n - mean[a] * mean[b]
                means.append(mean)
                bases.append(list(np.linalg.eigh(cov)[1][:, ::-1][:, : min(components, d - 1)].T))
            yield rows[keys].assign(_mean=means, _basis=bases)

    return run


def fleet_anomalies(windows: DataFrame, train_s: float, components: int = 2, percentile: float = 99.0, keys: list[str] | None = None) -> DataFrame:
    """Residual norm of an unscaled, centred projection, fitted for each segment; windows after training above
    the segment's threshold are flagged.

    Training windows are centred before ``train_s``; where there are fewer than five, the first half trains,
    five at least. A fit reads sums of the training windows only, one row for each segment.
    """
    keys = list(keys or [])
    cols = [c for c in windows.columns if c.endswith(("__mean", "__std"))]
    early = F.col("t_center_s") < train_s
    sizes = windows.groupBy(*keys).agg(F.count(F.when(early, 1)).alias("_early"), F.greatest(F.lit(5), F.floor(F.count(F.lit(1)) / 2)).alias("_half"))
    w = _with_row(windows, sizes, keys).withColumn("is_train", F.when(F.col("_early") >= 5, early).otherwise(F.col("k") < F.col("_half"))).drop("_early", "_half")
    d = len(cols)
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{a}") for a, c in enumerate(cols)]]
    sums += [F.sum(F.col(cols[a]) * F.col(cols[b])).alias(f"g{a}x{b}") for a in range(d) for b in range(a, d)]
    train = w.where("is_train")
    fields = "".join(f"{k} {windows.schema[k].dataType.simpleString()}, " for k in keys)
    fits = train.groupBy(*keys).agg(*sums).mapInPandas(_principal(keys, d, components), f"{fields}_mean array<double>, _basis array<array<double>>")
    add = lambda acc, x: acc + x
    total = lambda xs: F.aggregate(xs, F.lit(0.0), add)
    z = F.zip_with(F.array(*cols), "_mean", lambda x, m: x - m)
    loads = F.transform("_basis", lambda b: total(F.zip_with(b, "_z", lambda u, v: u * v)))
    back = F.aggregate(F.zip_with("_basis", "_l", lambda b, f: F.transform(b, lambda u: u * f)), F.transform("_z", lambda v: F.lit(0.0)), lambda acc, x: F.zip_with(acc, x, lambda u, v: u + v))
    rest = F.zip_with("_z", back, lambda u, v: (u - v) * (u - v))
    scored = _with_row(w, fits, keys).withColumn("_z", z).withColumn("_l", loads).withColumn("score", F.sqrt(total(rest)))
    scored = scored.select(*w.columns, "score")
    thr = thresholds(scored.where("is_train"), keys, 1 - percentile / 100.0)
    out = _with_row(scored, thr, keys)
    return out.withColumn("flag", (~F.col("is_train") & (F.col("score") >= F.col("threshold"))).cast("int"))


def hourly_counts(times: DataFrame, streams: DataFrame, bucket_s: float, time: str = "t_center_s", keys: list[str] | None = None) -> DataFrame:
    """Flag counts for all 24 hours of the day and every segment, by the hour of the bucket a flag falls in."""
    keys = list(keys or [])
    last = streams.groupBy(*keys).agg(F.max("i").alias("_last"))
    at = times.select(*keys, F.col(time).alias("_t"))
    j = _with_row(at, last, keys).withColumn("i", F.least(F.floor(F.col("_t") / bucket_s), F.col("_last"))).join(streams.select(*keys, "i", "hour"), [*keys, "i"])
    c = j.groupBy(*keys, "hour").agg(F.count(F.lit(1)).alias("n"))
    hours = last.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return hours.join(c, [*keys, "hour"], "left").fillna(0, ["n"])


def plausibility(flagged: DataFrame, hourly: DataFrame, note: str = "", disclaimer: str = DISCLAIMER, keys: list[str] | None = None) -> DataFrame:
    """Verdict rows per segment: flag volume below 10 %, a peak of 1.5 times the mean hour, disclaimer present."""
    keys = list(keys or [])
    a = flagged.groupBy(*keys).agg(F.sum("flag").alias("f"), F.count(F.when(~F.col("is_train"), 1)).alias("n"))
    g1 = a.select(*keys, F.lit("G1").alias("code"), F.when(F.col("n") > 0, F.col("f") / F.col("n")).otherwise(1.0).alias("value"))
    g2 = hourly.groupBy(*keys).agg(F.max("n").alias("p"), F.avg("n").alias("m")).select(
        *keys, F.lit("G2").alias("code"), F.when(F.col("m") > 0, F.col("p") / F.col("m")).otherwise(0.0).alias("value")
    )
    g3 = a.select(*keys, F.lit("G3").alias("code"), F.lit(1.0 if disclaimer.lower() in note.lower() else 0.0).alias("value"))
    passed = (
        F.when(F.col("code") == "G1", F.col("value") < 0.10).when(F.col("code") == "G2", F.col("value") >= 1.5).otherwise(F.col("value") > 0)
    )
    return g1.unionByName(g2).unionByName(g3).withColumn("passed", passed)


def change_points(streams: DataFrame, detector, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Change points of fleet series in time order, as (stream_name, t_s); segments lead the name."""
    from .drift import run_sequential

    keys = list(keys or [])
    long = streams.unpivot([*keys, "t_s"], [F.col(c).cast("double").alias(c) for c in columns], "stream_name", "value").withColumnRenamed("t_s", "time_s")
    long = long.withColumn("stream_name", F.concat_ws("/", *[F.col(k).cast("string") for k in keys], "stream_name")).drop(*keys)
    fired = run_sequential(long, {"ADWIN": detector})
    return fired.select("stream_name", F.col("time_s").alias("t_s")).orderBy("t_s", "stream_name")
