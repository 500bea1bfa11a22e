"""Constrained ranking of configurations, Pareto fronts and intervention records."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from .joins import asof_join, interval_join
from .scale import BROADCAST_ROWS, fits, grouped_quantiles, null_safe_join
from .surrogate import CONTEXT, CONTROLLED, TARGETS

OPS = {"<=": Column.__le__, ">=": Column.__ge__, "<": Column.__lt__, ">": Column.__gt__}


@dataclass(frozen=True)
class Constraint:
    """An inequality on a predicted target."""

    target: str
    op: str
    value: float

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op!r}")

    def column(self) -> Column:
        return OPS[self.op](F.col(self.target), F.lit(float(self.value)))


def inverse_query(
    contexts: DataFrame,
    grid: DataFrame,
    surrogate,
    constraints: list[Constraint] | None = None,
    score_target: str = "hosr",
    direction: str = "max",
    key: str = "context_id",
) -> DataFrame:
    """All candidates per context with predictions, ``feasible``, ``rank`` and ``n_feasible``.

    ``rank`` orders feasible candidates first and then by the target; rows with feasible = true are
    the recommendations. ``grid`` is the bounded configuration list.
    """
    if direction not in ("max", "min"):
        raise ValueError(f"direction must be max or min, not {direction!r}")
    require_columns(contexts, [key, *CONTEXT], "contexts")
    require_columns(grid, CONTROLLED, "candidate grid")
    unknown = sorted(({c.target for c in constraints or []} | {score_target}) - set(surrogate.targets))
    if unknown:
        raise ValueError(f"no surrogate for {unknown}")
    packed = grid.select(*CONTROLLED).distinct().agg(F.collect_set(F.struct(*CONTROLLED)).alias("_grid"))
    cand = contexts.crossJoin(F.broadcast(packed)).withColumn("_c", F.explode("_grid")).drop("_grid")
    cand = cand.select("*", *[F.col(f"_c.{c}").alias(c) for c in CONTROLLED]).drop("_c")
    out = surrogate.predict_interval(surrogate.predict(cand))
    ok = F.lit(True)
    for c in constraints or []:
        ok = ok & F.coalesce(c.column(), F.lit(False))
    best = F.col(score_target).desc() if direction == "max" else F.col(score_target).asc()
    w = Window.partitionBy(key)  # one grid per context
    return out.withColumn("feasible", ok).withColumns(
        {
            "rank": F.row_number().over(w.orderBy(F.col("feasible").desc(), best, *CONTROLLED)),
            "n_feasible": F.sum(F.col("feasible").cast("long")).over(w),
            "n_candidates": F.count(F.lit(1)).over(w),
        }
    )


def pareto_front(df: DataFrame, objectives: list[tuple[str, str]], cap: int = BROADCAST_ROWS) -> DataFrame:
    """Rows no other row dominates (at least as good everywhere, better somewhere); duplicates stay.

    Batches first drop rows dominated inside the batch, which removes nearly everything. The few
    survivors, as distinct points of a checked size, then decide the rest. While too many survive,
    they are dealt out anew, until they stop shrinking.
    """
    if not objectives:
        return df
    cols = [c for c, _ in objectives]
    sign = np.array([1.0 if d == "max" else -1.0 for _, d in objectives])
    points = df.select(*cols)

    def local(batches):
        for pdf in batches:
            m = pdf[cols].to_numpy(float) * sign
            alive = np.argsort(-m.sum(1), kind="stable")  # a dominating row has a larger sum
            keep: list[int] = []
            while len(alive):
                p, rest = m[alive[0]], alive[1:]
                keep.append(alive[0])
                worse = (p >= m[rest]).all(1) & (p > m[rest]).any(1)
                same = (p == m[rest]).all(1)
                alive = rest[~(worse | same)]
            yield pdf.iloc[sorted(keep)]

    schema = points.schema
    survivors = points.mapInPandas(local, schema).distinct()
    last = None
    while not fits(survivors, cap):
        n = survivors.count()
        if last is not None and n >= last:
            break
        last = n
        survivors = survivors.repartition(max(1, n // cap)).mapInPandas(local, schema).distinct()
    better = survivors.withColumnsRenamed({c: f"_b_{c}" for c in cols})
    ge, gt = F.lit(True), F.lit(False)
    for c, d in objectives:
        a, b = F.col(c), F.col(f"_b_{c}")
        ge = ge & ((b >= a) if d == "max" else (b <= a))
        gt = gt | ((b > a) if d == "max" else (b < a))
    side = F.broadcast(better) if fits(better, cap) else better
    return df.join(side, ge & gt, "left_anti")


# --- interventions -----------------------------------------------------------------------------


def deployment_context(samples: DataFrame, triggers: DataFrame, window: float = 60.0) -> DataFrame:
    """Signal quantiles over the closed interval [t - window, t] per trigger; NULLs and n = 0 when empty."""
    if window <= 0:
        raise ValueError("the context window must be positive")
    raw = {"rsrp_serving_dbm": ("rsrp", "dbm"), "sinr_serving_db": ("sinr", "db"), "rsrq_serving_db": ("rsrq", "db")}
    require_columns(samples, ["time_s", *raw], "samples")
    iv = triggers.select("t_s", (F.col("t_s") - window).alias("_lo"), F.col("t_s").alias("_hi")).distinct()
    j = interval_join(samples.select("time_s", *raw), iv, "time_s", "_lo", "_hi", closed=True)
    spec = {c: {f"{m}_{q}_{u}": p for q, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))} for c, (m, u) in raw.items()}
    q = grouped_quantiles(j, ["t_s"], spec, [F.count(F.lit(1)).alias("context_n_samples")])
    return null_safe_join(triggers, q, ["t_s"]).withColumn("context_n_samples", F.coalesce("context_n_samples", F.lit(0).cast("long")))


def config_in_force(triggers: DataFrame, events: DataFrame, chunk: float = 86_400.0) -> DataFrame:
    """Configuration stamped on the latest event at or before each trigger (NULL before the first)."""
    named = events.select("event_time_s", "event_id", *[F.col(f"cfg_{c}").cast("double").alias(f"current_{c}") for c in CONTROLLED])
    return asof_join(triggers, named, "t_s", "event_time_s", [f"current_{c}" for c in CONTROLLED], chunk=chunk, tie="event_id")


def phase_configs(events: DataFrame) -> DataFrame:
    """Event count, time range and first configuration per phase."""
    per = events.groupBy("phase_id", *[F.col(f"cfg_{c}").cast("double").alias(c) for c in CONTROLLED]).agg(
        F.count(F.lit(1)).alias("n"), F.min("event_time_s").alias("a"), F.max("event_time_s").alias("b"), F.min("event_id").alias("e")
    )
    g = per.groupBy("phase_id").agg(
        F.sum("n").alias("n_events"), F.min("a").alias("t_min_s"), F.max("b").alias("t_max_s"),
        F.min_by(F.struct(*CONTROLLED), F.struct("a", "e")).alias("_c"),
    )
    return g.select("phase_id", "n_events", "t_min_s", "t_max_s", *[F.col(f"_c.{c}").alias(c) for c in CONTROLLED])


def drift_triggers(retrain_log: DataFrame) -> DataFrame:
    """Trigger times of drift refits and the streams that fired."""
    d = retrain_log.where(F.col("reason").startswith("drift:"))
    names = F.filter(F.transform(F.split(F.expr("substring(reason, 7)"), ","), lambda x: F.trim(x)), lambda x: x != "")
    return d.select("t_s", F.array_join(names, ",").alias("drift_streams_fired"))


def interventions(
    triggers: DataFrame, samples: DataFrame, events: DataFrame, grid: DataFrame, surrogate, constraints: list[Constraint], window: float = 60.0, chunk: float = 86_400.0
) -> DataFrame:
    """One flat record per trigger: context, current and recommended configuration, predictions, uplift.

    Triggers without a finite context or a known configuration are left out. The record schema is
    the same when nothing is recommended.
    """
    t = config_in_force(deployment_context(samples, triggers, window), events, chunk)
    need = [*CONTEXT, *[f"current_{c}" for c in CONTROLLED]]
    t = t.dropna(subset=need)
    ranked = inverse_query(t.withColumn("context_id", F.col("t_s")), grid, surrogate, constraints)
    top = ranked.where(F.col("rank") == 1).withColumnsRenamed(
        {**{c: f"recommended_{c}" for c in CONTROLLED}, **{x: f"pred_recommended_{x}" for x in TARGETS}}
    )
    for x in TARGETS:
        for side in ("lo", "hi"):
            src = F.col(f"{x}_{side}") if f"{x}_{side}" in top.columns else F.lit(None).cast("double")
            top = top.withColumn(f"pred_recommended_{x}_{side}", src).drop(f"{x}_{side}")
    now = surrogate.predict(t.select("t_s", *CONTEXT, *[F.col(f"current_{c}").alias(c) for c in CONTROLLED]))
    now = now.select("t_s", *[F.col(x).alias(f"pred_current_{x}") for x in TARGETS])
    out = null_safe_join(top, now, ["t_s"], "inner")
    changed = F.lit(False)
    for c in CONTROLLED:
        changed = changed | (F.abs(F.col(f"recommended_{c}") - F.col(f"current_{c}")) > 1e-9)
    gain = {x: (F.col(f"pred_recommended_{x}") - F.col(f"pred_current_{x}")) * (1.0 if x == "hosr" else -1.0) for x in TARGETS}
    return out.select(
        F.col("t_s").alias("t_trigger_s"), "drift_streams_fired", "n_feasible", "n_candidates", changed.alias("cfg_changed"), "context_n_samples",
        *[f"current_{c}" for c in CONTROLLED], *[f"recommended_{c}" for c in CONTROLLED],
        *[f"pred_current_{x}" for x in TARGETS], *[f"pred_recommended_{x}" for x in TARGETS],
        *[f"pred_recommended_{x}_{s}" for x in TARGETS for s in ("lo", "hi")], *[gain[x].alias(f"signed_uplift_{x}") for x in TARGETS], *CONTEXT,
    )


def cumulative_uplift(records: DataFrame) -> DataFrame:
    """Running signed uplift in trigger order (one row per trigger)."""
    w = Window.orderBy("t_trigger_s").rowsBetween(Window.unboundedPreceding, 0)
    return records.select("t_trigger_s", *[F.sum(f"signed_uplift_{x}").over(w).alias(f"cum_uplift_{x}") for x in TARGETS])


def intervention_verdicts(records: DataFrame, drift: DataFrame, grid: DataFrame) -> DataFrame:
    """D2..D5: at least 5 triggers, recommendations on the grid, all changes near D-4, positive uplift."""
    g = grid.select(*[F.col(c).alias(f"recommended_{c}") for c in CONTROLLED])
    inside = records.join(F.broadcast(g.distinct()), [f"recommended_{c}" for c in CONTROLLED], "left_semi").agg(F.count(F.lit(1)).alias("k"))
    base = records.agg(F.count(F.lit(1)).alias("n"), F.sum("signed_uplift_hosr").alias("u"))
    d4 = drift.where(F.col("drift_id") == "D-4").select((F.col("start_time_s") - 5.0).alias("_lo"), (F.col("end_time_s") + 60.0).alias("_hi"))
    near = interval_join(records.select("t_trigger_s", "cfg_changed"), d4, "t_trigger_s", "_lo", "_hi", closed=True, how="left_semi").agg(
        F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("cfg_changed"), 1)).alias("c")
    )
    one = base.crossJoin(F.broadcast(inside)).crossJoin(F.broadcast(near))  # single rows
    rows = F.array(
        F.struct(F.lit("D2").alias("code"), (F.col("n") >= 5).alias("passed")),
        F.struct(F.lit("D3").alias("code"), ((F.col("n") > 0) & (F.col("k") == F.col("n"))).alias("passed")),
        F.struct(F.lit("D4").alias("code"), ((F.col("m") > 0) & (F.col("m") == F.col("c"))).alias("passed")),
        F.struct(F.lit("D5").alias("code"), F.coalesce(F.col("u") > 0, F.lit(False)).alias("passed")),
    )
    return one.select(F.explode(rows).alias("_r")).select("_r.code", "_r.passed")
