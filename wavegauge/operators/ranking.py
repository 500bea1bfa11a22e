"""Ranking metrics, flag rates and resampled intervals for scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw, ratio
from .resampling import replicate_ap
from .scale import HOT_GROUP_ROWS, dense_position, grouped_quantiles, largest_group, null_safe_join, prefix_sum


def ranking_metrics(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", weight: str | None = None, small: bool | None = None) -> DataFrame:
    """Average precision and ROC-AUC per key over distinct score thresholds; NULL for one class.

    Rows are first collapsed to one row per distinct score, then accumulated with ``prefix_sum``.
    """
    w = F.col(weight) if weight else F.lit(1)
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    steps = d.groupBy(*keys, F.col(score).cast("double").alias("_score")).agg(
        F.sum(F.col(label).cast("long") * w).alias("_pos"), F.sum(w.cast("long")).alias("_n")
    )
    r = prefix_sum(steps, keys, "_score", ["_pos", "_n"], descending=True, small=small)
    neg = F.col("_n") - F.col("_pos")
    above = F.col("cum__pos") - F.col("_pos")
    out = r.groupBy(*keys).agg(
        F.sum(F.col("_pos") * F.col("cum__pos") / F.col("cum__n")).alias("_ap"),
        F.sum(neg * (above + F.col("_pos") / 2)).alias("_auc"),
        F.sum("_pos").cast("long").alias("n_pos"),
        F.sum(neg).cast("long").alias("n_neg"),
    )
    two = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(
        *keys,
        F.when(two, F.col("_ap") / F.col("n_pos")).alias("ap"),
        F.when(two, F.col("_auc") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"),
        "n_pos",
        "n_neg",
    )


def flag_rates(df: DataFrame, keys: list[str], flag: str = "flag", label: str = "label") -> DataFrame:
    """True and false positive rates with class sizes; NULL when a class is absent."""
    pos, neg = F.col(label) == 1, F.col(label) == 0
    return df.groupBy(*keys).agg(
        F.avg(F.when(pos, F.col(flag))).alias("tpr"),
        F.avg(F.when(neg, F.col(flag))).alias("fpr"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(pos, 1)).alias("n_pos"),
        F.count(F.when(neg, 1)).alias("n_neg"),
    )


def thresholds(train_scores: DataFrame, keys: list[str], flag_frac: float = 0.05, score: str = "score") -> DataFrame:
    """Score threshold per key: the (1 - flag_frac) quantile of the training scores."""
    return grouped_quantiles(train_scores, keys, {score: {"threshold": 1.0 - flag_frac}})


def apply_thresholds(scored: DataFrame, thr: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    return null_safe_join(scored, thr, keys).withColumn("flag", (F.col(score) >= F.col("threshold")).cast("int"))


def resample_positions(sizes: DataFrame, keys: list[str], n: str, n_draw: str, reps: int, salt: Column) -> DataFrame:
    """Positions drawn with replacement per stratum: columns keys, rep, pos and picks.

    ``sizes`` has one row per stratum with its row count and number of draws. The draw index is
    expanded in two steps so that no stratum is generated by a single task.
    """
    block = 1024
    d = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    d = d.withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n_draw) - 1) / block))))
    d = d.repartition(*keys, "rep", "_blk")
    first = F.col("_blk") * block
    last = F.least(first + block, F.col(n_draw)) - 1
    d = d.where(F.col(n_draw) > 0).withColumn("_j", F.explode(F.sequence(first, last)))
    key = F.concat_ws("|", F.col("rep").cast("string"), salt, F.col("_j").cast("string"))
    return d.withColumn("pos", draw(key, F.col(n))).groupBy(*keys, "rep", "pos").agg(F.count(F.lit(1)).alias("picks"))


def bootstrap_ap(
    df: DataFrame,
    keys: list[str],
    score: str = "score",
    label: str = "label",
    reps: int = 1000,
    alpha: float = 0.05,
    stratify: bool = True,
) -> DataFrame:
    """Average precision with a percentile interval from row resampling.

    Replicates come from ``resampling.replicate_ap``; those with a single class are dropped and
    ``n_valid`` counts the rest. Rows without score or label take no part.
    """
    d = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *keys, F.col(score).cast("double").alias("_s"), F.col(label).cast("int").alias("_y")
    )
    small = True if largest_group(d, keys) <= HOT_GROUP_ROWS else None
    per_rep = replicate_ap(d, keys, "_s", "_y", reps, stratify).where(F.col("ap").isNotNull())
    ci = grouped_quantiles(
        per_rep, keys, {"ap": {"ci_low": alpha / 2, "ci_high": 1 - alpha / 2}}, [F.count(F.lit(1)).alias("n_valid")],
        small=True,  # at most one row per replicate
    )
    point = ranking_metrics(d, keys, "_s", "_y", small=small).select(*keys, "ap", "n_pos", "n_neg")
    return null_safe_join(point, ci, keys).withColumn("n_valid", F.coalesce("n_valid", F.lit(0).cast("long")))


def bootstrap_statistic(
    df: DataFrame, keys: list[str], value: str, stat: str = "mean", reps: int = 1000, alpha: float = 0.05, min_rows: int = 1
) -> DataFrame:
    """Percentile interval of the mean or median of ``value`` per key; NULLs are dropped first.

    Groups with fewer than ``min_rows`` values keep NULL bounds.
    """
    d = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    small = True if largest_group(d, keys) <= HOT_GROUP_ROWS else None
    pos = dense_position(d, keys, "_v", small=small)
    sizes = pos.groupBy(*keys).agg(F.max("n").alias("n"))
    salt = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("all")
    picks = resample_positions(sizes, keys, "n", "n", reps, salt)
    hit = null_safe_join(picks, pos.drop("n"), [*keys, "pos"], "inner")
    if stat == "mean":
        rep = hit.groupBy(*keys, "rep").agg((F.sum(F.col("_v") * F.col("picks")) / F.sum("picks")).alias("_b"))
    else:
        rep = _weighted_median(hit, [*keys, "rep"], small)
    ci = grouped_quantiles(rep, keys, {"_b": {"ci_low": alpha / 2, "ci_high": 1 - alpha / 2}}, small=True)
    centre = {"_v": {"median": 0.5}}
    point = grouped_quantiles(d, keys, centre, [F.count(F.lit(1)).alias("n_obs"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std")], small=small)
    out = null_safe_join(point, ci, keys)
    enough = F.col("n_obs") >= min_rows
    return out.withColumns({c: F.when(enough, F.col(c)) for c in ("ci_low", "ci_high")})


def _weighted_median(hit: DataFrame, keys: list[str], small: bool | None = None) -> DataFrame:
    steps = hit.groupBy(*keys, "_v").agg(F.sum("picks").alias("n"))
    r = prefix_sum(steps, keys, "_v", ["n"], small=small)
    lo, hi = F.floor((F.col("tot_n") - 1) / 2), F.ceil((F.col("tot_n") - 1) / 2)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("cum_n") > rank) & (F.col("cum_n") - F.col("n") <= rank), F.col("_v")))

    return r.groupBy(*keys).agg(((at(lo) + at(hi)) / 2).alias("_b"))


def format_interval(point: Column, low: Column, high: Column, decimals: int = 3) -> Column:
    """``0.732 [0.690, 0.771]``, or ``nan`` when the point is undefined."""
    f = f"%.{decimals}f"
    return F.when(point.isNull(), F.lit("nan")).otherwise(F.format_string(f"{f} [{f}, {f}]", point, low, high))


def sliding_ap(
    df: DataFrame,
    keys: list[str],
    window: float = 120.0,
    stride: float = 30.0,
    min_pos: int = 2,
    min_neg: int = 5,
    score: str = "score",
    label: str = "label_anomaly",
    time: str = "t_mid_s",
) -> DataFrame:
    """Average precision around moving centres; both window ends are closed.

    A series shorter than the window gets one centre at its middle. Counts are always reported;
    the score is NULL where a class is too small.
    """
    d = df.where(F.col(score).isNotNull())
    half = window / 2.0
    span = d.groupBy(*keys).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))
    n = F.ceil((F.col("_hi") - half + 1e-9 - (F.col("_lo") + half)) / stride)
    centres = span.withColumn("_short", F.col("_hi") - F.col("_lo") < window).withColumn(
        "_c", F.explode(F.when(F.col("_short"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1)))
    )
    centre = F.when(F.col("_short"), (F.col("_lo") + F.col("_hi")) / 2).otherwise(F.col("_lo") + half + F.col("_c") * stride)
    centres = centres.select(*keys, centre.alias("t_center_s"))
    # A row belongs to the few centres within half a window: find them by stride number.
    j = null_safe_join(d, span, keys, "inner").withColumn("_short", F.col("_hi") - F.col("_lo") < window)
    rel = F.col(time) - F.col("_lo") - half
    k0 = F.greatest(F.lit(0).cast("long"), F.floor((rel - half) / stride) - 1)
    k1 = F.greatest(k0, F.ceil((rel + half) / stride) + 1)
    j = j.withColumn("_c", F.explode(F.when(F.col("_short"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(k0, k1))))
    j = j.withColumn("t_center_s", centre)
    j = j.where((F.col(time) >= F.col("t_center_s") - half) & (F.col(time) <= F.col("t_center_s") + half))
    m = ranking_metrics(j, [*keys, "t_center_s"], score, label)
    out = null_safe_join(centres, m, [*keys, "t_center_s"])
    enough = (F.col("n_pos") >= min_pos) & (F.col("n_neg") >= min_neg)
    return out.select(
        *keys,
        "t_center_s",
        F.when(enough, F.col("ap")).alias("pr_auc"),
        F.coalesce("n_pos", F.lit(0).cast("long")).alias("n_pos"),
        F.coalesce("n_neg", F.lit(0).cast("long")).alias("n_neg"),
    )


def cost_ledger(log: DataFrame, keys: list[str]) -> DataFrame:
    """Fit count, training volume, fit time and first refit after warm-up per run."""
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_refits"),
        F.sum("n_train_samples").cast("long").alias("n_train_samples_sum"),
        F.sum("fit_cpu_s").alias("fit_cpu_s_sum"),
        F.avg("fit_cpu_s").alias("fit_cpu_s_mean"),
        F.avg("n_train_samples").alias("n_train_samples_mean"),
        F.min(F.when(F.col("reason") != "warmup", F.col("t_s"))).alias("first_refit_t_s"),
    )


def regression_scores(df: DataFrame, keys: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """MAE, RMSE and R2 over finite pairs; R2 is NULL when the target does not vary."""
    a, p = F.col(actual), F.col(predicted)
    ok = a.isNotNull() & p.isNotNull() & ~F.isnan(a) & ~F.isnan(p) & (F.abs(a) < float("inf")) & (F.abs(p) < float("inf"))
    d = df.where(ok)
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(a - p)).alias("mae"),
        F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"),
        F.avg((a - p) * (a - p)).alias("_mse"),
        F.var_pop(a).alias("_var"),
    )
    return out.withColumn("r2", F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var"))).drop("_mse", "_var")


def interval_coverage(
    df: DataFrame, keys: list[str], actual: str = "actual", low: str = "low", high: str = "high", nominal: str = "nominal"
) -> DataFrame:
    """Share of targets inside the closed interval and its mean width, per nominal level."""
    inside = (F.col(actual) >= F.col(low)) & (F.col(actual) <= F.col(high))
    return df.where(F.col(actual).isNotNull() & F.col(low).isNotNull() & F.col(high).isNotNull()).groupBy(*keys, nominal).agg(
        F.count(F.lit(1)).alias("n"), F.avg(inside.cast("int")).alias("coverage"), F.avg(F.col(high) - F.col(low)).alias("mean_width")
    )


def check_nominal(levels: list[float]) -> None:
    bad = [x for x in levels if not 0 < x < 1]
    if bad:
        raise ValueError(f"nominal coverage must lie in (0, 1): {bad}")


def class_ratio(n: str, d: str) -> Column:
    return ratio(F.col(n), F.col(d))
