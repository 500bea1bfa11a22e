"""Causal replay of refit strategies.

Refit decisions depend on time and drift firings only, so the epoch table is computed first. Models
are then fitted epoch by epoch, and every window is scored in one pass by the model in force.
"""

from __future__ import annotations

import time
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .joins import asof_join, interval_join
from .ranking import cost_ledger, ranking_metrics
from .scale import HOT_GROUP_ROWS, fits, grouped_quantiles, null_safe_join

EPOCH_SCHEMA = "t_s double, reason string"
LOG_SCHEMA = "strategy string, t_s double, reason string, n_train_samples long, n_train_samples_pre_filter long, fit_cpu_s double"


class Strategy:
    """A refit rule: ``epochs(decisions, signals)`` gives the refit times and reasons.

    ``decisions`` has the column t_end_s; ``signals`` has t_s (decision time) and streams (the
    sorted streams that fired since the decision before).
    """

    name = "base"

    def epochs(self, decisions: DataFrame, signals: DataFrame) -> DataFrame:
        raise NotImplementedError


class Static(Strategy):
    name = "static"

    def epochs(self, decisions, signals):
        return decisions.sparkSession.createDataFrame([], EPOCH_SCHEMA)


class Periodic(Strategy):
    name = "periodic"

    def __init__(self, period: float = 180.0):
        if period <= 0:
            raise ValueError("the period must be positive")
        self.period = period

    def epochs(self, decisions, signals):
        """The first decision starts the clock; a refit is due at the first decision ``period`` later."""
        t = decisions.select("t_end_s").distinct()
        spark, reason = decisions.sparkSession, f"periodic:{self.period:g}s"
        if fits(t, HOT_GROUP_ROWS):
            times = np.sort(np.array([r[0] for r in t.collect()]))  # bounded by the check
            out, k = [], 0
            while k < len(times):
                k = max(k + 1, int(np.searchsorted(times, times[k] + self.period)))
                while k < len(times) and times[k] - (out[-1] if out else times[0]) < self.period:
                    k += 1
                if k < len(times):
                    out.append(float(times[k]))
            return spark.createDataFrame([(x, reason) for x in out], EPOCH_SCHEMA)
        # One small filtered minimum per refit; the sorted file lets each skip nearly all row groups.
        t = materialise(t.repartitionByRange("t_end_s").sortWithinPartitions("t_end_s"), "decisions")
        last, out = t.agg(F.min("t_end_s")).first()[0], []
        while True:
            nxt = t.where((F.col("t_end_s") > last) & (F.col("t_end_s") - F.lit(last) >= self.period)).agg(F.min("t_end_s")).first()[0]
            if nxt is None:
                return spark.createDataFrame([(x, reason) for x in out], EPOCH_SCHEMA)
            out.append(float(nxt))
            last = nxt


class DriftTriggered(Strategy):
    name = "drift_triggered"

    def __init__(self, cooldown: float = 30.0, watch: list[str] | None = None):
        if cooldown < 0:
            raise ValueError("the cooldown must not be negative")
        self.cooldown, self.watch = cooldown, watch

    def epochs(self, decisions, signals):
        """Refit when a watched stream fired, unless the last refit was less than the cooldown ago.

        A signal inside the cooldown is lost. The fold runs over decision times with a signal: at
        most one per firing.
        """
        s = signals.select("t_s", F.array_sort("streams").alias("streams"))
        if self.watch is not None:
            keep = F.array(*[F.lit(w) for w in self.watch])
            s = s.select("t_s", F.array_intersect("streams", keep).alias("streams"))
        s = s.where(F.size("streams") > 0)
        packed = s.agg(F.sort_array(F.collect_list(F.struct("t_s", F.concat(F.lit("drift:"), F.array_join("streams", ",")).alias("reason")))).alias("_s"))
        start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<struct<t_s:double,reason:string>>").alias("out"))
        due = lambda acc, x: acc["last"].isNull() | (x["t_s"] - acc["last"] >= self.cooldown)
        folded = F.aggregate(
            "_s",
            start,
            lambda acc, x: F.struct(
                F.when(due(acc, x), x["t_s"]).otherwise(acc["last"]).alias("last"),
                F.when(due(acc, x), F.concat(acc["out"], F.array(x))).otherwise(acc["out"]).alias("out"),
            ),
        )
        return packed.select(F.explode(folded["out"]).alias("_e")).select("_e.t_s", "_e.reason")


def decision_signals(windows: DataFrame, firings: DataFrame, chunk: float = 86_400.0) -> DataFrame:
    """Streams that fired between one decision time and the next: t_s and the sorted streams.

    A firing is seen at the first window end at or after it; later firings are never seen.
    """
    ends = windows.select("t_end_s")
    f = firings.select("stream_name", "time_s").distinct()
    seen = asof_join(f, ends, "time_s", "t_end_s", ["t_end_s"], chunk=chunk, forward=True).where(F.col("t_end_s").isNotNull())
    return seen.groupBy(F.col("t_end_s").alias("t_s")).agg(F.array_sort(F.collect_set("stream_name")).alias("streams"))


def warmup_pool(windows: DataFrame, max_phase: int = 3) -> DataFrame:
    return windows.where((F.col("phase_id") <= max_phase) & (F.col("label_anomaly") == 0))


def retrain_pools(windows: DataFrame, epochs: DataFrame, window: float = 120.0) -> DataFrame:
    """Windows with t_end in (t - window, t] for every epoch time, labels ignored."""
    iv = epochs.select(F.col("t_s"), (-F.col("t_s")).alias("_a"), (F.lit(float(window)) - F.col("t_s")).alias("_b"))
    d = interval_join(windows.withColumn("_neg", -F.col("t_end_s")), iv, "_neg", "_a", "_b")
    return d.drop("_neg", "_a", "_b")


def model_in_force(windows: DataFrame, times: list[float]) -> DataFrame:
    """Add ``epoch``: how many refits happened at or before the window end (0 = warm-up model)."""
    t = F.array(*[F.lit(float(x)) for x in times]) if times else F.array().cast("array<double>")
    return windows.withColumn("epoch", F.size(F.filter(t, lambda x: x <= F.col("t_end_s"))))


def score_by_epoch(windows: DataFrame, models: list, columns: list[str]) -> DataFrame:
    """Each row goes through the model of its epoch; rows of an epoch without a model get NULL.

    Models that are a function of the row are applied in one pass; others, such as neighbour models,
    score the rows of their epoch as a table.
    """
    if not all(m is None or hasattr(m, "fn") for m in models):
        parts = [
            windows.where(F.col("epoch") == i).withColumn("score", F.lit(None).cast("double")) if m is None else m.score(windows.where(F.col("epoch") == i))
            for i, m in enumerate(models)
        ]
        return reduce(lambda a, b: a.unionByName(b), parts)
    held = [m and (m.pre.median, m.pre.mean, m.pre.std, m.fn) for m in models]  # shipped with the function

    @F.pandas_udf("double")
    def run(epoch: pd.Series, raw: pd.Series) -> pd.Series:
        out = np.full(len(epoch), np.nan)
        x = np.stack(raw.to_numpy()).astype(float) if len(raw) else np.empty((0, len(columns)))
        for e in np.unique(epoch):
            m = held[int(e)]
            if m is None:
                continue
            at = np.flatnonzero(epoch.to_numpy() == e)
            med, mean, std, fn = m
            part = np.where(np.isnan(x[at]), np.array([v if v is not None else 0.0 for v in med], float), x[at])
            out[at] = fn((part - np.array(mean)) / np.array(std))
        return pd.Series(out)

    raw = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])
    s = run("epoch", raw)
    return windows.withColumn("score", s).withColumn("score", F.when(~F.isnan("score"), F.col("score")))


def replay(
    windows: DataFrame,
    firings: DataFrame,
    strategy: Strategy,
    scorer,
    columns: list[str],
    key: list[str],
    warmup_phase: int = 3,
    pool_window: float = 120.0,
    filter_quantile: float | None = None,
    chunk: float = 86_400.0,
    name: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Scored post-warm-up windows and the refit log of one strategy.

    ``scorer`` is a scorer class. With ``filter_quantile`` a pool keeps only rows the current model
    scores at or below that quantile. An empty pool keeps the model in force and is logged.
    """
    if not columns:
        raise ValueError("no feature columns")
    if pool_window <= 0:
        raise ValueError("pool_window must be positive")
    if filter_quantile is not None and not 0 < filter_quantile < 1:
        raise ValueError("filter_quantile must lie between 0 and 1")
    spark, name = windows.sparkSession, name or strategy.name
    warm = warmup_pool(windows, warmup_phase)
    head = warm.agg(F.max("t_end_s").alias("t"), F.count(F.lit(1)).alias("n")).first()
    post = windows.where(F.col("phase_id") > warmup_phase)
    if not head["n"]:
        log = spark.createDataFrame([(name, 0.0, "warmup_failed", 0, 0, 0.0)], LOG_SCHEMA)
        return post.limit(0).withColumns({"score": F.lit(None).cast("double"), "strategy": F.lit(name)}), log

    def fit(pool: DataFrame):
        t0 = time.process_time()
        m = scorer(columns, key).fit(pool)
        return m, time.process_time() - t0

    windows = windows.select(*dict.fromkeys([*key, "phase_id", "t_mid_s", "t_end_s", "label_anomaly", *columns]))
    post = windows.where(F.col("phase_id") > warmup_phase)
    model, cpu = fit(warm)
    models, times = [model], []
    log = [(name, float(head["t"]), "warmup", int(head["n"]), int(head["n"]), cpu)]
    signals = decision_signals(post, firings.where(F.col("time_s") > float(head["t"])), chunk)
    plan = sorted(strategy.epochs(post, signals).collect(), key=lambda r: r["t_s"])  # one row per refit
    for e in plan:
        t = float(e["t_s"])
        pool = windows.where((F.col("t_end_s") <= t) & (F.col("t_end_s") > t - pool_window))
        n = kept = pool.count()
        if n == 0:
            log.append((name, t, f"{e['reason']}_skip_empty", 0, 0, 0.0))
            continue
        if filter_quantile is not None:
            scored = materialise(models[-1].score(pool, "_current"), "pool")
            cut = grouped_quantiles(scored.where(F.col("_current").isNotNull()), [], {"_current": {"q": filter_quantile}}).first()
            good = scored.where(F.col("_current") <= cut["q"]) if cut and cut["q"] is not None else scored
            kept = good.count()
            pool, kept = (good, kept) if kept else (pool, n)
        model, cpu = fit(pool)
        models.append(model)
        times.append(t)
        log.append((name, t, e["reason"], int(kept), int(n), cpu))
    scored = score_by_epoch(model_in_force(post, times), models, columns)
    return scored.withColumn("strategy", F.lit(name)), spark.createDataFrame(log, LOG_SCHEMA)


def default_runs(period: float = 180.0, cooldown: float = 30.0, watch: list[str] | None = None, quantile: float = 0.8) -> list[tuple[str, Strategy, float | None]]:
    """The four compared runs: display name, strategy, filter quantile."""
    return [
        ("static", Static(), None),
        ("periodic", Periodic(period), None),
        ("drift_triggered_naive", DriftTriggered(cooldown, watch), None),
        ("drift_triggered_filtered", DriftTriggered(cooldown, watch), quantile),
    ]


def run_summary(scored: DataFrame, log: DataFrame, drift_phases: DataFrame) -> DataFrame:
    """Overall and drift-phase average precision and cost per strategy."""
    overall = ranking_metrics(scored, ["strategy"], "score", "label_anomaly").select("strategy", F.col("ap").alias("overall_pr_auc"))
    under = scored.join(drift_phases, "phase_id", "left_semi")
    part = ranking_metrics(under, ["strategy"], "score", "label_anomaly").select("strategy", F.col("ap").alias("drift_phase_pr_auc"))
    cost = cost_ledger(log, ["strategy"])
    cost = cost.select("strategy", *[F.col(c).alias(f"cost__{c}") for c in cost.columns if c != "strategy"])
    return null_safe_join(null_safe_join(cost, overall, ["strategy"]), part, ["strategy"])


def adaptive_verdicts(summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """C2: filtered overall at least periodic; C3: filtered in drift phases at least static + 0.10; for each of ``keys``."""
    keys = keys or []
    pick = lambda s, c: F.max(F.when(F.col("strategy") == s, F.col(c)))
    head = "drift_triggered_filtered"
    one = summary.groupBy(*keys).agg(
        (pick(head, "overall_pr_auc") - pick("periodic", "overall_pr_auc")).alias("a"),
        (pick(head, "drift_phase_pr_auc") - pick("static", "drift_phase_pr_auc")).alias("b"),
    )
    rows = F.array(
        F.struct(F.lit("C2").alias("code"), F.col("a").alias("delta"), F.coalesce(F.col("a") >= -1e-6, F.lit(False)).alias("passed")),
        F.struct(F.lit("C3").alias("code"), F.col("b").alias("delta"), F.coalesce(F.col("b") >= 0.10 - 1e-6, F.lit(False)).alias("passed")),
    )
    return one.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
