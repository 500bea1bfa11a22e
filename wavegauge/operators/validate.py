"""Stability of findings across runs: long metric tables (run, metric, num, txt, kind)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import bootstrap_statistic

WINNERS = {
    "anomaly": "anomaly__winning_detector",
    "anomaly__per_type_mean": "anomaly__winning_detector_per_type_mean",
    "anomaly__overall": "anomaly__winning_detector_overall",
    "drift": "drift__winning_detector",
}


def metric_stability(metrics: DataFrame, reps: int = 5000, alpha: float = 0.05) -> DataFrame:
    """Mean, sample deviation and resampled interval of the mean per metric; NULL below two values."""
    keep = ~F.col("metric").endswith("__winning_detector") & ~F.col("metric").endswith("__missing") & F.col("kind").isin("number", "bool")
    d = metrics.where(keep & F.col("num").isNotNull() & ~F.isnan("num"))
    out = bootstrap_statistic(d, ["metric"], "num", "mean", reps, alpha, min_rows=2)
    two = F.col("n_obs") >= 2
    return out.select("metric", F.col("n_obs").alias("n"), F.when(two, F.col("mean")).alias("mean"), F.when(two, F.col("std")).alias("std"), F.col("ci_low").alias("ci_lo"), F.col("ci_high").alias("ci_hi"))


def winner_stability(metrics: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Most frequent winner per ranking and its share of the runs."""
    name = F.lit(None).cast("string")
    for k, m in WINNERS.items():
        name = F.when(F.col("metric") == m, k).otherwise(name)
    d = metrics.select(name.alias("pipeline"), "txt").where(F.col("pipeline").isNotNull() & F.col("txt").isNotNull())
    c = d.groupBy("pipeline", "txt").agg(F.count(F.lit(1)).alias("n"))
    out = c.groupBy("pipeline").agg(F.max_by("txt", F.struct("n", "txt")).alias("winner"), F.max("n").alias("_m"), F.sum("n").alias("n_runs"))
    return out.select("pipeline", "winner", "n_runs", (F.col("_m") / F.col("n_runs")).alias("modal_share")).withColumn("stable", F.col("modal_share") >= threshold)


def replication_verdicts(metrics: DataFrame, stability: DataFrame, winners: DataFrame) -> DataFrame:
    """E1..E5: nothing missing, stable winners, two positive effects, stable drift volume."""
    e1 = metrics.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("metric").endswith("__missing") & (F.col("num") == 1), 1)).alias("k")).select(
        F.lit("E1").alias("code"), F.col("k").cast("double").alias("value"), ((F.col("k") == 0) & (F.col("n") > 0)).alias("passed")
    )
    w = lambda c, *names: winners.agg(
        *[F.max(F.when(F.col("pipeline") == p, F.col("modal_share"))).alias(f"s{k}") for k, p in enumerate(names)]
    ).select(F.lit(c).alias("code"), F.coalesce(*[F.col(f"s{k}") for k in range(len(names))]).alias("value")).withColumn("passed", F.coalesce(F.col("value") >= 0.8, F.lit(False)))
    m = lambda c: F.max(F.when(F.col("metric") == c[0], F.col(c[1])))
    pos = lambda code, metric: stability.agg(m((metric, "mean")).alias("value"), m((metric, "ci_lo")).alias("_lo")).select(
        F.lit(code).alias("code"), "value", F.coalesce((F.col("value") > 0) & (F.col("_lo") > 0), F.lit(False)).alias("passed")
    )
    n = "drift__n_detections"
    e5 = stability.agg(m((n, "mean")).alias("_m"), m((n, "std")).alias("_s")).select(
        F.lit("E5").alias("code"), F.when(F.col("_m") > 0, F.col("_s") / F.col("_m")).alias("value")
    ).withColumn("passed", F.coalesce(F.col("value") < 0.30, F.lit(False)))
    parts = [e1, w("E2a", "anomaly__per_type_mean", "anomaly"), w("E2b", "anomaly__overall"), pos("E3", "adaptive__delta_filtered_minus_naive"), pos("E4", "demo__cum_uplift_hosr"), e5]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metric_deltas(base: DataFrame, contrast: DataFrame) -> DataFrame:
    """Difference per metric over the union of names; flags and texts get none, tiny bases no ratio."""
    side = lambda d, s: d.select("metric", F.col("num").alias(f"{s}_num"), F.col("txt").alias(f"{s}_txt"), F.col("kind").alias(f"{s}_kind"))
    j = side(base, "base").join(side(contrast, "contrast"), "metric", "full_outer")
    both = (F.col("base_kind") == "number") & (F.col("contrast_kind") == "number")
    d = F.when(both, F.col("contrast_num") - F.col("base_num"))
    show = lambda s: F.coalesce(F.col(f"{s}_txt"), F.col(f"{s}_num").cast("string"))
    return j.select(
        "metric", show("base").alias("base"), show("contrast").alias("contrast"), "base_num", "contrast_num", d.alias("delta"),
        F.when(F.abs("base_num") > 1e-12, d / F.abs("base_num")).alias("relative_delta"),
    )


def top_detectors(per_type: DataFrame, fallback: DataFrame | None = None, k: int = 2) -> DataFrame:
    """The k detectors with the best mean precision per run; runs without any take the named winner."""
    m = per_type.where(F.col("pr_auc").isNotNull()).groupBy("run", "detector").agg(F.avg("pr_auc").alias("mean_ap"))
    w = Window.partitionBy("run").orderBy(F.col("mean_ap").desc(), "detector")  # one row per detector
    top = m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("run", "detector", "rank")
    if fallback is None:
        return top
    rest = fallback.join(m.select("run").distinct(), "run", "left_anti").where(F.col("detector").isNotNull())
    return top.unionByName(rest.select("run", "detector", F.lit(1).alias("rank")))


def detector_overlap(top: DataFrame, base: str, contrast: str) -> DataFrame:
    a, b = (top.where(F.col("run") == x).select("detector") for x in (base, contrast))
    return a.intersect(b)


def portability_verdicts(base: DataFrame, contrast: DataFrame, overlap: DataFrame) -> DataFrame:
    """F1..F5: no missing pipelines, shared top detectors, both deltas positive, an intervention, uplift."""
    both = base.select("metric", "num", F.lit("b").alias("s")).unionByName(contrast.select("metric", "num", F.lit("c").alias("s")))
    v = lambda s, m: F.max(F.when((F.col("s") == s) & (F.col("metric") == m), F.col("num")))
    one = both.agg(
        F.count(F.when(F.col("metric").endswith("__missing"), 1)).alias("miss"),
        v("b", "adaptive__delta_filtered_minus_naive").alias("db"),
        v("c", "adaptive__delta_filtered_minus_naive").alias("dc"),
        v("c", "demo__n_interventions").alias("n"),
        v("c", "demo__cum_uplift_hosr").alias("u"),
    ).crossJoin(F.broadcast(overlap.agg(F.count(F.lit(1)).alias("o"))))
    no = F.lit(False)
    tests = {
        "F1": F.col("miss") == 0,
        "F2": F.col("o") > 0,
        "F3": (F.col("db") > 0) & (F.col("dc") > 0),
        "F4": F.col("n") >= 1,
        "F5": F.col("u") > 0,
    }
    rows = F.array(*[F.struct(F.lit(k).alias("code"), F.coalesce(t, no).alias("passed")) for k, t in tests.items()])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")


def long_table(base: DataFrame, contrast: DataFrame, base_name: str, contrast_name: str) -> DataFrame:
    """Both runs stacked: one row per metric and run over the union of metrics, missing values NULL."""
    d = metric_deltas(base, contrast)
    rows = F.array(*[F.struct(F.lit(n).alias("timeline"), F.col(c).alias("value")) for n, c in ((base_name, "base"), (contrast_name, "contrast"))])
    return d.select("metric", F.explode(rows).alias("_r")).select("metric", "_r.*")


def wide_runs(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Run x metric table for the listed numeric metrics."""
    return metrics.groupBy("run").pivot("metric", names).agg(F.first("num"))
