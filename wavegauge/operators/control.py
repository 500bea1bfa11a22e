"""Handover control events derived from recorded measurements and event logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .joins import asof_join, neighbour_row
from .scale import fitting_chunk, grouped_quantiles, null_safe_join

DAY = 86_400.0


def best_two_cells(meas: DataFrame, keys: list[str], cell: str = "cell_id", level: str = "rsrp_dbm") -> DataFrame:
    """Serving and best neighbour per tick: the two strongest cells, ties to the smaller cell id.

    Two nested maxima, so every tick is combined map-side and never sorted.
    """
    rank = F.struct(F.col(level).alias("v"), (-F.col(cell)).alias("c"))
    cells = meas.where(F.col(level).isNotNull()).groupBy(*keys, cell).agg(F.max(level).alias(level))
    top = cells.groupBy(*keys).agg(F.max(rank).alias("_first"))
    rest = null_safe_join(cells, top, keys, "inner")
    second = rest.groupBy(*keys).agg(
        F.max("_first").alias("_first"), F.max(F.when(F.col(cell) != -F.col("_first.c"), rank)).alias("_second")
    )
    return second.select(
        *keys,
        (-F.col("_first.c")).alias("serving_cell_id"),
        F.col("_first.v").alias("rsrp_serving_dbm"),
        (-F.col("_second.c")).alias("neighbor_cell_id"),
        F.col("_second.v").alias("rsrp_neighbor_dbm"),
    )


def smooth(df: DataFrame, keys: list[str], time: str, value: str, alpha: float = 0.5, chunk: float = DAY, tie: str | None = None) -> DataFrame:
    """Exponential smoothing F = (1 - alpha) F + alpha M per key; NULL keeps the last value.

    The recurrence is linear, so a time chunk acts on the incoming value as a * F + b. The pairs
    (a, b) are computed per chunk inside Spark, chained over the few chunks of a key, and every
    chunk is then smoothed independently from its own starting value. Adds ``smoothed``.
    """
    order = [time] + ([tie] if tie else [])
    chunk = fitting_chunk(df, keys, time, chunk)
    d = df.withColumn("_chunk", F.floor(F.col(time) / chunk))
    ck = [*keys, "_chunk"]
    good = d.where(F.col(value).isNotNull())
    w = Window.partitionBy(*ck)
    j = F.row_number().over(w.orderBy(*order))
    good = good.withColumns({"_j": j, "_m": F.count(F.lit(1)).over(w)})
    decay = F.pow(F.lit(1 - alpha), (F.col("_m") - F.col("_j")).cast("double"))
    parts = good.groupBy(*ck).agg(
        F.pow(F.lit(1 - alpha), F.count(F.lit(1)).cast("double")).alias("_a"),
        F.sum(decay * alpha * F.col(value)).alias("_b"),
        F.min_by(value, F.struct(*order)).alias("_head"),
    )
    # Chain the chunk maps in order: one short row per chunk, streamed through a task per key.
    chain_schema = parts.select(*ck).schema.add("_in", "double").add("_out", "double")

    def chain(batches):
        current, f = None, None
        for pdf in batches:
            ins, outs = [], []
            for g, a, b, head in zip(zip(*[pdf[k] for k in keys]), pdf["_a"], pdf["_b"], pdf["_head"]):
                if g != current:
                    current, f = g, None
                ins.append(f)
                f = (head if f is None else f) * a + b
                outs.append(f)
            yield pdf[ck].assign(_in=pd.Series(ins, dtype="float64", index=pdf.index), _out=pd.Series(outs, dtype="float64", index=pdf.index))

    carry = parts.repartition(*keys).sortWithinPartitions(*ck).mapInPandas(chain, chain_schema)
    carry = carry.withColumn("_in", F.when(~F.isnan("_in"), F.col("_in")))
    # Chunks with NULLs only inherit the smoothed value of the chunk before them.
    every = null_safe_join(d.select(*ck).distinct(), carry, ck)
    prev = F.last("_out", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    every = every.select(*ck, F.coalesce("_in", prev).alias("_in"))
    ready = null_safe_join(d, every, ck).repartition(*ck).sortWithinPartitions(*ck, *order)
    schema = ready.drop("_in", "_chunk").schema.add("smoothed", "double")
    cols = [f.name for f in schema.fields][:-1]

    def fold(batches):
        current, f = None, None
        for pdf in batches:
            group = list(zip(*[pdf[k] for k in ck]))
            out = []
            for g, v, first in zip(group, pdf[value], pdf["_in"]):
                if g != current:
                    current, f = g, (None if pd.isna(first) else float(first))
                if not pd.isna(v):
                    f = float(v) if f is None else (1 - alpha) * f + alpha * float(v)
                out.append(f)
            yield pdf[cols].assign(smoothed=pd.Series(out, dtype="float64", index=pdf.index))

    return ready.mapInPandas(fold, schema)


def run_starts(df: DataFrame, keys: list[str], time: str, cond: str, chunk: float, tie: str) -> DataFrame:
    """Rows where boolean ``cond`` holds, with ``run_start``: the time their unbroken run began."""
    d = neighbour_row(df.withColumn("_c", F.coalesce(F.col(cond), F.lit(False))), keys, [time, tie], ["_c"], time, chunk)
    begins = F.col("_c") & ~F.coalesce(F.col("adj__c"), F.lit(False))
    starts = d.where(begins).select(*keys, F.col(time).alias("run_start"))
    return asof_join(d.where(F.col("_c")).drop("_c", "adj__c"), starts, time, "run_start", ["run_start"], by=keys, chunk=chunk)


def a3_entries(ticks: DataFrame, hyst_db: float, offset_db: float, ttt: float, dt: float, chunk: float = DAY) -> DataFrame:
    """Time-to-trigger entries: one row per (ue, tick) with the smallest qualifying cell.

    ``ticks`` holds ue_id, time_s, cell_id, rsrp_dbm and serving_dbm for every non-serving cell. The
    entry condition must hold on enough consecutive ticks of a cell (count * dt >= ttt).
    """
    need = max(1, int(-(-(ttt - 1e-9) // dt)))
    cond = (F.col("rsrp_dbm") - F.lit(float(hyst_db))) > (F.col("serving_dbm") + F.lit(float(offset_db)))
    runs = run_starts(ticks.withColumn("_cond", cond), ["ue_id", "cell_id"], "time_s", "_cond", chunk, "cell_id")
    w = Window.partitionBy("ue_id", "cell_id", "run_start").orderBy("time_s")
    fired = runs.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == need)
    return fired.groupBy("ue_id", "time_s").agg(F.min("cell_id").alias("target_cell_id"))


def handover_outcomes(
    attempts: DataFrame, failures: DataFrame, exec_s: float, best_cells: DataFrame | None = None, chunk: float = DAY
) -> DataFrame:
    """Success after ``exec_s`` unless a link failure of the same ue comes first (then it fails there).

    ``best_cells`` (ue_id, time_s, serving_cell_id) gives the cell taken after a failure.
    """
    f = failures.select("ue_id", F.col("time_s").alias("failed_at"))
    out = asof_join(attempts, f, "event_time_s", "failed_at", ["failed_at"], by=["ue_id"], chunk=chunk, forward=True)
    fails = F.col("failed_at").isNotNull() & (F.col("failed_at") <= F.col("event_time_s") + exec_s)
    out = out.withColumns(
        {
            "outcome": F.when(fails, "fail").otherwise("success"),
            "outcome_time_s": F.when(fails, F.col("failed_at")).otherwise(F.col("event_time_s") + exec_s),
        }
    ).drop("failed_at")
    if best_cells is None:
        return out
    b = best_cells.select("ue_id", F.col("time_s").alias("_bt"), F.col("serving_cell_id").alias("_best"))
    out = asof_join(out, b, "outcome_time_s", "_bt", ["_best"], by=["ue_id"], chunk=chunk)
    after = F.when(F.col("outcome") == "fail", F.col("_best")).otherwise(F.col("target_cell_id"))
    return out.withColumn("cell_after", after).drop("_best")


def ping_pongs(success: DataFrame, window: float = 5.0, chunk: float = DAY) -> DataFrame:
    """Successes that return to the source of the previous success within ``window``."""
    d = neighbour_row(success, ["ue_id"], ["event_time_s", "event_id"], ["source_cell_id", "event_time_s"], "event_time_s", chunk)
    back = (F.col("target_cell_id") == F.col("adj_source_cell_id")) & (F.col("event_time_s") - F.col("adj_event_time_s") < window)
    return d.where(back).drop("adj_source_cell_id", "adj_event_time_s")


def time_to_next(events: DataFrame, chunk: float = DAY) -> DataFrame:
    """Time to the next event of the same ue, NULL for the last one."""
    d = neighbour_row(events, ["ue_id"], ["event_time_s", "event_id"], ["event_time_s"], "event_time_s", chunk, forward=True)
    return d.withColumn("t_to_next_event_s", F.col("adj_event_time_s") - F.col("event_time_s")).drop("adj_event_time_s")


def cell_transitions(df: DataFrame, max_gap: float = 60.0, chunk: float = DAY, tie: str = "time_s") -> DataFrame:
    """Serving-cell changes within (operator, ran type) and less than ``max_gap`` apart."""
    keys = ["operator_id", "ran_type"]
    order = ["time_s"] + ([tie] if tie != "time_s" else [])
    d = df.where(F.col("operator_id").isNotNull() & F.col("ran_type").isNotNull())
    d = neighbour_row(d, keys, order, ["serving_cell_id", "time_s"], "time_s", chunk)
    dt = F.col("time_s") - F.col("adj_time_s")
    hit = (F.col("serving_cell_id") != F.col("adj_serving_cell_id")) & (dt < max_gap)
    return d.where(hit).select(
        "time_s", dt.alias("dt_s"), *keys, "band", F.col("adj_serving_cell_id").alias("source_cell_id"), F.col("serving_cell_id").alias("target_cell_id"),
        *([tie] if tie != "time_s" else []),
    )


def rapid_bounces(transitions: DataFrame, window: float, chunk: float = DAY, tie: str = "time_s") -> DataFrame:
    """Transitions whose next transition returns to the source within ``window``."""
    keys = ["operator_id", "ran_type"]
    order = ["time_s"] + ([tie] if tie != "time_s" else [])
    d = neighbour_row(transitions, keys, order, ["target_cell_id", "time_s"], "time_s", chunk, forward=True)
    back = (F.col("adj_target_cell_id") == F.col("source_cell_id")) & (F.col("adj_time_s") - F.col("time_s") <= window)
    return d.where(back).drop("adj_target_cell_id").withColumnRenamed("adj_time_s", "return_time_s")


FAULT_FIELDS = "anomaly_type string, t_start_s double, t_end_s double, ue_ids array<int>, cell_ids array<int>, delta_db double, rate_db_per_s double, stuck_value_dbm double"


def inject_faults(meas: DataFrame, specs: DataFrame) -> DataFrame:
    """Apply fault specifications (a short ordered list, column ``ord``) to a measurement table.

    Bursts and interference add to SINR and half to RSRQ (interference only on its cells), ramps add
    rate * (t - start) to SINR, stuck values replace RSRP; the last matching specification wins. A
    stuck fault without a value freezes the first level of that ue and cell inside the interval.
    """
    packed = specs.agg(F.sort_array(F.collect_list(F.struct("ord", *[c for c in specs.columns if c != "ord"]))).alias("_specs"))
    t, ue, cell = F.col("time_s"), F.col("ue_id").cast("int"), F.col("cell_id").cast("int")
    hits = F.filter(
        "_specs",
        lambda s: (t >= s["t_start_s"]) & (t < s["t_end_s"]) & (s["ue_ids"].isNull() | F.array_contains(s["ue_ids"], ue)),
    )
    d = meas.crossJoin(F.broadcast(packed)).withColumn("_hits", hits).drop("_specs")

    def total(expr):
        return F.aggregate("_hits", F.lit(0.0), lambda acc, s: acc + F.coalesce(expr(s), F.lit(0.0)))

    on_cell = lambda s: s["cell_ids"].isNull() | F.array_contains(s["cell_ids"], cell)
    burst = lambda s: F.when(
        (s["anomaly_type"] == "rlf_burst") | ((s["anomaly_type"] == "interference_spike") & on_cell(s)), s["delta_db"]
    )
    ramp = lambda s: F.when(s["anomaly_type"] == "slow_degrade", s["rate_db_per_s"] * (t - s["t_start_s"]))
    glitch = F.filter("_hits", lambda s: s["anomaly_type"] == "meas_glitch")
    d = d.withColumns({"_burst": total(burst), "_ramp": total(ramp), "_g": F.get(F.reverse(glitch), F.lit(0))})
    frozen = (
        d.where(F.col("_g").isNotNull() & F.col("_g.stuck_value_dbm").isNull())
        .groupBy("ue_id", "cell_id", F.col("_g.ord").alias("_ord"))
        .agg(F.min_by("rsrp_dbm", "time_s").alias("_frozen"))
    )
    d = null_safe_join(d.withColumn("_ord", F.col("_g.ord")), frozen, ["ue_id", "cell_id", "_ord"])
    stuck = F.when(F.col("_g").isNotNull(), F.coalesce(F.col("_g.stuck_value_dbm"), F.col("_frozen")))
    return d.withColumns(
        {
            "rsrp_dbm": F.coalesce(stuck, F.col("rsrp_dbm")),
            "rsrq_db": F.col("rsrq_db") + F.col("_burst") / 2,
            "sinr_db": F.col("sinr_db") + F.col("_burst") + F.col("_ramp"),
        }
    ).select(*meas.columns)


def cell_kpis(samples: DataFrame, events: DataFrame, step: float = 1.0) -> DataFrame:
    """Per cell and time step: signal quantiles, event counts, success ratio and distinct ues."""
    keys = ["cell_id", "t"]
    s = samples.select(F.col("serving_cell_id").alias("cell_id"), F.floor(F.col("time_s") / step).alias("t"), "ue_id", "rsrp_serving_dbm", "sinr_serving_db")
    spec = {
        "rsrp_serving_dbm": {"rsrp_p10": 0.1, "rsrp_p50": 0.5, "rsrp_p90": 0.9},
        "sinr_serving_db": {"sinr_p10": 0.1, "sinr_p50": 0.5, "sinr_p90": 0.9},
    }
    q = grouped_quantiles(s, keys, spec, [F.avg("rsrp_serving_dbm").alias("rsrp_mean"), F.countDistinct("ue_id").alias("n_ue")])
    kinds = {"HO_ATTEMPT": "n_ho_attempt", "HO_SUCCESS": "n_ho_success", "HO_FAIL": "n_ho_fail", "RLF": "n_rlf", "PING_PONG": "n_ping_pong"}
    e = events.groupBy(F.col("source_cell_id").alias("cell_id"), F.floor(F.col("event_time_s") / step).alias("t")).agg(
        *[F.count(F.when(F.col("event_type") == k, 1)).alias(c) for k, c in kinds.items()]
    )
    out = q.join(e, keys, "full_outer").fillna(0, [*kinds.values(), "n_ue"])
    return out.withColumn("hosr", F.col("n_ho_success") / F.greatest(F.col("n_ho_attempt"), F.lit(1)))


def run_kpis(rows: DataFrame, keys: list[str], n_ue: float, duration: float) -> DataFrame:
    """One row per run: event counts, ratios to attempts (NULL without attempts), failures per
    ue-second and signal quantiles by midpoint plotting positions."""
    kinds = {"HO_ATTEMPT": "ho_attempt", "HO_SUCCESS": "ho_success", "HO_FAIL": "ho_fail", "RLF": "rlf", "PING_PONG": "pp"}
    counts = [F.count(F.when(F.col("event_type") == k, 1)).alias(f"{c}_count") for k, c in kinds.items()]
    finite = rows
    for c in ("rsrp_dbm", "sinr_db", "rsrq_db"):
        finite = finite.withColumn(c, F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)))
    spec = {f"{m}_{u}": {f"{m}_{q}_{u}": p for q, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))} for m, u in (("rsrp", "dbm"), ("sinr", "db"), ("rsrq", "db"))}
    out = grouped_quantiles(finite, keys, spec, counts, midpoint=True)
    a = F.col("ho_attempt_count")
    return out.withColumns(
        {
            "hosr": ratio(F.col("ho_success_count"), a),
            "hofr_rate": ratio(F.col("ho_fail_count"), a),
            "ping_pong_rate": ratio(F.col("pp_count"), a),
            "rlf_rate": F.col("rlf_count") / F.lit(float(n_ue * duration)),
        }
    )


def mean_ratio_grid(runs: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Success ratio of seed-averaged counts on a two-parameter grid (ratio of means, wide)."""
    m = runs.groupBy(row, column).agg(F.avg("ho_success_count").alias("_s"), F.avg("ho_attempt_count").alias("_a"))
    m = m.withColumn("_r", F.col("_s") / F.greatest(F.col("_a"), F.lit(1.0)))
    return m.groupBy(row).pivot(column, values).agg(F.first("_r"))


def enrich_events(events: DataFrame, samples: DataFrame, columns: list[str], chunk: float = DAY) -> DataFrame:
    """Event rows with the sample just before (``pre_``) and just after (``post_``) of the same ue.

    The sample before has a time < the event, the sample after a time > the event.
    """
    s = samples.select("ue_id", F.col("time_s").alias("_st"), *columns)
    out = events
    for prefix, fwd in (("pre_", False), ("post_", True)):
        named = s.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})
        out = asof_join(out, named, "event_time_s", "_st", [f"{prefix}{c}" for c in columns], by=["ue_id"], chunk=chunk, forward=fwd, strict=True)
    return out
