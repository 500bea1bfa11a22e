"""Descriptive statistics and two-sample distribution tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ranking import resample_positions
from .resampling import SHARED_STEPS, replicate_ks
from .scale import dense_position, fits, grouped_quantiles, null_safe_join, prefix_sum

P3 = {"p10": 0.10, "p50": 0.50, "p90": 0.90}


def segment_census(df: DataFrame, keys: list[str], columns: dict[str, str], time: str = "time_s", cell: str = "serving_cell_id") -> DataFrame:
    """Rows, time span in hours, quantiles and distinct cells per segment; NULL keys are kept."""
    spec = {c: {f"{short}_{q}": p for q, p in P3.items()} for c, short in columns.items()}
    extra = [
        F.count(F.lit(1)).alias("n_rows"),
        ((F.max(time) - F.min(time)) / 3600.0).alias("t_span_h"),
        F.countDistinct(cell).alias("n_serving_cells"),
    ]
    return grouped_quantiles(df, keys, spec, extra)


def unpivot(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.unpivot(keys, [F.col(c).cast("double").alias(c) for c in columns], "kpi", "v")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, range and 5/50/95 % quantiles per column."""
    d = unpivot(df, [], columns).where(F.col("v").isNotNull())
    extra = [
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
    ]
    return grouped_quantiles(d, ["kpi"], {"v": {"p5": 0.05, "p50": 0.5, "p95": 0.95}}, extra)


def missing_fractions(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return one.unpivot([], columns, "kpi", "missing")


def histogram(df: DataFrame, keys: list[str], column: str, start: float, width: float, bins: int) -> DataFrame:
    """Counts of equal-width bins; the last bin includes its upper edge, values outside are dropped."""
    top = start + width * bins
    v = F.col(column)
    b = F.when(v == top, F.lit(bins - 1)).otherwise(F.floor((v - start) / width))
    d = df.where((v >= start) & (v <= top)).groupBy(*keys, b.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return d.withColumn("bin_start", F.lit(start) + F.col("bin") * width)


def ecdf(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Distinct values with the share of rows at or below them."""
    c = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return prefix_sum(c, keys, "x", ["n"]).select(*keys, "x", "n", (F.col("cum_n") / F.col("tot_n")).alias("cdf"))


def top_segments(census: DataFrame, keys: list[str], k: int = 4) -> DataFrame:
    """The k largest segments of a census."""
    return census.orderBy(F.col("n_rows").desc(), *keys).limit(k)


def qq_pairs(a: DataFrame, b: DataFrame, column: str, max_points: int = 2000) -> DataFrame:
    """Paired quantiles of two samples at evenly spaced probabilities in [0.005, 0.995]."""
    a, b = (x.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x")) for x in (a, b))
    n = min(a.count(), b.count(), max_points)
    if n == 0:
        raise ValueError("both samples need values")
    step = 0.99 / (n - 1) if n > 1 else 0.0

    def at_probs(d: DataFrame, name: str) -> DataFrame:
        c = d.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
        r = prefix_sum(c, [], "x", ["n"], with_next=True)
        # A value of ranks first to cum_n - 1 serves the probabilities whose rank h falls on it: their
        # numbers follow from the ranks, so no join is needed.
        first = F.col("cum_n") - F.col("n")
        if n > 1:
            number = lambda rank: (rank / (F.col("tot_n") - 1) - 0.005) / F.lit(step)
            k_lo = F.greatest(F.lit(0), F.floor(number(first)) - 1).cast("long")
            k_hi = F.least(F.lit(n - 1), F.ceil(number(F.col("cum_n"))) + 1).cast("long")
            ks = F.when(k_lo <= k_hi, F.sequence(k_lo, k_hi))
        else:
            ks = F.array(F.lit(0).cast("long"))
        j = r.withColumn("k", F.explode(ks)).withColumn("p", F.lit(0.005) + F.col("k") * F.lit(step))
        h = F.col("p") * (F.col("tot_n") - 1)
        lo = F.floor(h)
        j = j.where((lo >= first) & (lo < F.col("cum_n")))
        nxt = F.when(lo + 1 < F.col("cum_n"), F.col("x")).otherwise(F.coalesce("next_x", "x"))
        return j.select("k", "p", (F.col("x") + (nxt - F.col("x")) * (h - lo)).alias(name))

    return at_probs(a, "q_a").join(at_probs(b, "q_b").drop("p"), "k")


def outcome_ratio(df: DataFrame, keys: list[str], result: str = "result") -> DataFrame:
    """Attempt, success and failure counts and the success / attempt ratio (NULL without attempts)."""
    r = F.col(result)
    out = df.groupBy(*keys).agg(
        F.count(F.when(r == "Attempt", 1)).alias("n_attempt"),
        F.count(F.when(r == "Success", 1)).alias("n_success"),
        F.count(F.when(r.isin("Fail", "Failure"), 1)).alias("n_fail"),
    )
    return out.withColumn("hosr", F.when(F.col("n_attempt") > 0, F.col("n_success") / F.col("n_attempt")))


def ks_statistic(df: DataFrame, keys: list[str], value: str, side: str, min_rows: int = 10, weight: str | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per key; NULL when a side has fewer than ``min_rows``."""
    w = F.col(weight) if weight else F.lit(1)
    v = F.col(value).cast("double")
    d = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    c = d.groupBy(*keys, v.alias("_v")).agg(
        F.sum(F.col(side).cast("long") * w).cast("long").alias("_a"), F.sum((1 - F.col(side)).cast("long") * w).cast("long").alias("_b")
    )
    r = prefix_sum(c, keys, "_v", ["_a", "_b"])
    out = r.groupBy(*keys).agg(
        F.max(F.abs(F.col("cum__a") / F.col("tot__a") - F.col("cum__b") / F.col("tot__b"))).alias("_ks"),
        F.max("tot__a").alias("n_a"),
        F.max("tot__b").alias("n_b"),
    )
    return out.withColumn("ks", F.when((F.col("n_a") >= min_rows) & (F.col("n_b") >= min_rows), F.col("_ks"))).drop("_ks")


def ks_p_values(stats: DataFrame) -> DataFrame:
    """Asymptotic Kolmogorov p-value per KS row."""
    root = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")))
    lam = (root + 0.12 + 0.11 / root) * F.col("ks")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * lam * lam),
    )
    p = F.when(F.col("ks") > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))).otherwise(F.lit(1.0))
    return stats.withColumn("p_value", F.when(F.col("ks").isNotNull(), p))


def ks_bootstrap(df: DataFrame, keys: list[str], value: str, side: str, reps: int = 200, draw_cap: int | None = None) -> DataFrame:
    """95 % percentile interval of the KS distance; each resample draws as many rows as a side has, or ``draw_cap`` if given and fewer.

    Draws are counted by distinct value where these fit every task (counted); no draw is shuffled then.
    """
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), F.col(side).cast("int").alias("_side"))
    strata = [*keys, "_side"]
    interval = {"ks": {"ks_ci_lo": 0.025, "ks_ci_hi": 0.975}}
    salt = F.concat_ws("|", *[F.col(c).cast("string") for c in strata])
    steps = materialise(d.groupBy(*strata, "_v").agg(F.count(F.lit(1)).alias("n")), "ks-steps")
    if fits(steps, SHARED_STEPS):
        return grouped_quantiles(replicate_ks(steps, keys, reps, salt, draw_cap), keys, interval, small=True)
    pos = dense_position(d, strata, "_v")
    sizes = pos.groupBy(*strata).agg(F.max("n").alias("n")).withColumn("_m", F.least(F.col("n"), F.lit(draw_cap).cast("long")))  # NULL, no cap, is ignored
    picks = resample_positions(sizes, strata, "n", "_m", reps, salt)
    hit = null_safe_join(picks, pos.drop("n"), [*strata, "pos"], "inner")
    rep = ks_statistic(hit, [*keys, "rep"], "_v", "_side", weight="picks")
    return grouped_quantiles(rep, keys, interval, small=True)


def calibration_grid(sim: DataFrame, real: DataFrame, segments: DataFrame, kpis: list[str], group: list[str] | None = None) -> DataFrame:
    """KS distance, sizes and quantiles of a simulated and a recorded population per segment and KPI.

    ``segments`` lists the target segments (a small dimension); segments without recorded rows
    disappear. ``group`` adds keys of the simulated side, such as the configuration of a sweep.
    """
    group = group or []
    seg = segments.columns
    real_in = real.join(F.broadcast(segments), seg)
    a = unpivot(sim, group, kpis)
    b = unpivot(real_in, seg, kpis)
    present = b.select(*seg).distinct()
    packed = present.agg(F.collect_set(F.struct(*seg)).alias("_segs"))  # the listed segments only
    sim_long = a.crossJoin(F.broadcast(packed)).select(*group, "kpi", "v", F.explode("_segs").alias("_s"), F.lit(1).alias("side"))
    sim_long = sim_long.select(*group, *[F.col(f"_s.{c}").alias(c) for c in seg], "kpi", "v", "side")
    real_long = b.withColumn("side", F.lit(0))
    if group:
        names = sim.select(*group).distinct().agg(F.collect_set(F.struct(*group)).alias("_g"))  # configurations
        real_long = real_long.crossJoin(F.broadcast(names)).withColumn("_x", F.explode("_g"))
        real_long = real_long.select(*[F.col(f"_x.{g}").alias(g) for g in group], *seg, "kpi", "v", "side")
    both = sim_long.unionByName(real_long).where(F.col("v").isNotNull())
    keys = [*group, *seg, "kpi"]
    ks = ks_statistic(both, keys, "v", "side").withColumnsRenamed({"n_a": "n_sim", "n_b": "n_real"})
    q = grouped_quantiles(both, [*keys, "side"], {"v": P3})
    out = ks
    for s, name in ((1, "sim"), (0, "real")):
        part = q.where(F.col("side") == s).select(*keys, *[F.col(p).alias(f"{name}_{p}") for p in P3])
        out = null_safe_join(out, part, keys)
    return out.withColumn("delta_p50", F.col("sim_p50") - F.col("real_p50"))


def best_config(grid: DataFrame, focus: Column, config: str = "config") -> DataFrame:
    """Configurations of one segment and KPI ranked by KS distance; rank 1 is the best."""
    d = grid.where(focus)
    return d.withColumn("rank", F.row_number().over(Window.orderBy("ks", config)))  # one row per configuration


def time_coverage(df: DataFrame, keys: list[str], bin_s: float, time: str = "time_s", min_rows: int = 50) -> DataFrame:
    """Rows per time bin for segments with at least ``min_rows`` rows."""
    c = df.groupBy(*keys, F.floor(F.col(time) / bin_s).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    big = c.groupBy(*keys).agg(F.sum("n").alias("_n")).where(F.col("_n") >= min_rows)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return c.join(big.select(*[F.col(k).alias(f"_k_{k}") for k in keys]), cond, "left_semi")
