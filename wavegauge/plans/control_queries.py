"""Control events, fault injection and per-cell KPIs over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control as C
from ..session import materialise
from . import adapter as A
from .calibration_queries import DRIVE_SQL, drive
from .registry import i, query, r, tidy

MEAS_SQL = f"""{A.SAMPLES_SQL},
meas AS (SELECT ue_id, CAST(floor(time_s / 3) AS BIGINT) AS tick, serving_cell_id AS cell_id, max(rsrp_serving_dbm) AS rsrp_dbm FROM samples GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY ue_id, tick ORDER BY rsrp_dbm DESC, cell_id) AS rn FROM meas),
top2 AS (SELECT ue_id, tick, max(cell_id) FILTER (rn = 1) AS serving_cell_id, max(rsrp_dbm) FILTER (rn = 1) AS rsrp_serving_dbm,
  max(cell_id) FILTER (rn = 2) AS neighbor_cell_id, max(rsrp_dbm) FILTER (rn = 2) AS rsrp_neighbor_dbm FROM rk WHERE rn <= 2 GROUP BY 1, 2)"""


def meas(spark, d):
    t = A.telemetry(spark, d)
    return t.groupBy("ue_id", F.floor(F.col("time_s") / 3).alias("tick"), F.col("serving_cell_id").alias("cell_id")).agg(F.max("rsrp_serving_dbm").alias("rsrp_dbm"))


@query("t01_best_two_cells", f"WITH {MEAS_SQL} SELECT {i('ue_id', 'tick', 'serving_cell_id', 'neighbor_cell_id')}, {r('rsrp_serving_dbm', 'rsrp_neighbor_dbm')} FROM top2")
def q_top2(spark, d):
    return tidy(C.best_two_cells(meas(spark, d), ["ue_id", "tick"]))


@query(
    "t02_l3_smoothing",
    f"""WITH {A.SAMPLES_SQL}, x AS (SELECT ue_id, serving_cell_id AS cell, event_id, time_s, CASE WHEN k % 7 <> 0 OR k % 2 = 0 AND user_id % 3 > 0 THEN rsrp_serving_dbm END AS v FROM samples),
n AS (SELECT *, count(v) OVER (PARTITION BY ue_id, cell ORDER BY time_s, event_id) AS c FROM x),
g AS (SELECT ue_id, cell, v, c FROM n WHERE v IS NOT NULL),
f AS (SELECT a.ue_id, a.cell, a.c, sum(CASE WHEN b.c = 1 THEN b.v * pow(0.65432109::DOUBLE, a.c - 1) ELSE 0.34567891::DOUBLE * pow(0.65432109::DOUBLE, a.c - b.c) * b.v END) AS f FROM g a JOIN g b ON a.ue_id = b.ue_id AND a.cell = b.cell AND b.c <= a.c GROUP BY 1, 2, 3)
SELECT event_id, round(f.f, 6) AS smoothed FROM n LEFT JOIN f ON f.ue_id = n.ue_id AND f.cell = n.cell AND f.c = n.c""",
)
def q_smooth(spark, d):
    t = A.telemetry(spark, d)
    v = F.when((F.col("k") % 7 != 0) | ((F.col("k") % 2 == 0) & (F.col("user_id") % 3 > 0)), F.col("rsrp_serving_dbm"))
    x = t.select("ue_id", F.col("serving_cell_id").alias("cell"), "event_id", "time_s", v.alias("v"))
    return tidy(C.smooth(x, ["ue_id", "cell"], "time_s", "v", 0.34567891, chunk=72.0, tie="event_id").select("event_id", "smoothed"))


@query(
    "t03_a3_entries",
    f"""WITH {MEAS_SQL}, c AS (SELECT m.ue_id, m.tick, m.cell_id, m.rsrp_dbm - 0.5 > s.rsrp_serving_dbm - 12.0 AS cond FROM meas m JOIN top2 s USING (ue_id, tick) WHERE m.cell_id <> s.serving_cell_id),
g AS (SELECT *, sum(CAST(NOT cond AS INTEGER)) OVER (PARTITION BY ue_id, cell_id ORDER BY tick) AS grp FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY ue_id, cell_id, grp ORDER BY tick) AS rn FROM g WHERE cond)
SELECT {i('ue_id')}, round(CAST(tick AS DOUBLE), 6) AS time_s, CAST(min(cell_id) AS BIGINT) AS target_cell_id FROM k WHERE rn = 2 GROUP BY ue_id, tick""",
)
def q_a3(spark, d):
    m = materialise(meas(spark, d), "meas")
    s = C.best_two_cells(m, ["ue_id", "tick"]).select("ue_id", "tick", "serving_cell_id", F.col("rsrp_serving_dbm").alias("serving_dbm"))
    ticks = m.join(s, ["ue_id", "tick"]).where(F.col("cell_id") != F.col("serving_cell_id")).withColumn("time_s", F.col("tick").cast("double"))
    return tidy(C.a3_entries(ticks.drop("tick", "serving_cell_id"), 0.5, -12.0, ttt=2.0, dt=1.0, chunk=24.0))




@query(
    "t05_handover_outcomes",
    f"""WITH {A.SAMPLES_SQL}, a AS (SELECT event_id, ue_id, event_time_s, neighbor_cell_id AS target_cell_id FROM samples WHERE event_type = 'HO_ATTEMPT'),
b AS (SELECT a.event_id, min(s.event_time_s) AS failed_at FROM a JOIN samples s ON s.ue_id = a.ue_id AND s.event_type = 'RLF' AND s.event_time_s >= a.event_time_s AND s.event_time_s <= a.event_time_s + 2.0 GROUP BY 1),
o AS (SELECT a.*, CASE WHEN failed_at IS NULL THEN 'success' ELSE 'fail' END AS outcome, coalesce(failed_at, event_time_s + 2.0) AS outcome_time_s FROM a LEFT JOIN b USING (event_id))
SELECT o.event_id, outcome, round(outcome_time_s, 6) AS outcome_time_s, CAST(CASE WHEN outcome = 'fail' THEN s.serving_cell_id ELSE o.target_cell_id END AS BIGINT) AS cell_after
FROM o ASOF LEFT JOIN samples s ON s.ue_id = o.ue_id AND s.time_s <= o.outcome_time_s""",
)
def q_outcomes(spark, d):
    t = A.telemetry(spark, d)
    a = t.where("event_type = 'HO_ATTEMPT'").select("event_id", "ue_id", "event_time_s", F.col("neighbor_cell_id").alias("target_cell_id"))
    out = C.handover_outcomes(a, t.where("event_type = 'RLF'").select("ue_id", "time_s"), 2.0, t.select("ue_id", "time_s", "serving_cell_id"), chunk=24.0)
    return tidy(out.select("event_id", "outcome", "outcome_time_s", "cell_after"))


@query(
    "t06_ping_pong",
    f"""WITH {A.SAMPLES_SQL}, s AS (SELECT event_id, ue_id, event_time_s, k % 3 AS src, (k // 3) % 3 AS tgt FROM samples WHERE event_type = 'HO_SUCCESS'),
l AS (SELECT *, lag(src) OVER w AS psrc, lag(event_time_s) OVER w AS pt FROM s WINDOW w AS (PARTITION BY ue_id ORDER BY event_time_s, event_id))
SELECT event_id, {i('ue_id')}, round(event_time_s, 6) AS event_time_s FROM l WHERE tgt = psrc AND event_time_s - pt < 5.0""",
)
def q_pp(spark, d):
    t = A.telemetry(spark, d).where("event_type = 'HO_SUCCESS'")
    s = t.select("event_id", "ue_id", "event_time_s", (F.col("k") % 3).alias("source_cell_id"), (F.floor(F.col("k") / 3) % 3).alias("target_cell_id"))
    return tidy(C.ping_pongs(s, 5.0, chunk=24.0).select("event_id", "ue_id", "event_time_s"))


@query(
    "t07_time_to_next_event",
    f"WITH {A.SAMPLES_SQL} SELECT event_id, round(lead(event_time_s) OVER (PARTITION BY ue_id ORDER BY event_time_s, event_id) - event_time_s, 6) AS t_to_next_event_s FROM samples",
)
def q_next(spark, d):
    t = A.telemetry(spark, d).select("event_id", "ue_id", "event_time_s")
    return tidy(C.time_to_next(t, chunk=24.0).select("event_id", "t_to_next_event_s"))


TR_SQL = f"""{DRIVE_SQL}, lg AS (SELECT *, lag(serving_cell_id) OVER w AS src, lag(time_s) OVER w AS pt FROM drive WHERE operator_id IS NOT NULL WINDOW w AS (PARTITION BY operator_id, ran_type ORDER BY time_s, event_id)),
tr AS (SELECT event_id, time_s, time_s - pt AS dt_s, operator_id, ran_type, band, src AS source_cell_id, serving_cell_id AS target_cell_id FROM lg WHERE serving_cell_id <> src AND time_s - pt < 3600.0)"""


@query("t08_cell_transitions", f"WITH {TR_SQL} SELECT event_id, {i('operator_id', 'source_cell_id', 'target_cell_id')}, ran_type, band, round(dt_s, 4) AS dt_s FROM tr")
def q_transitions(spark, d):
    t = C.cell_transitions(drive(spark, d), 3600.0, tie="event_id").drop("time_s")
    return tidy(t, 4)


@query(
    "t09_rapid_bounce",
    f"WITH {TR_SQL}, n AS (SELECT *, lead(target_cell_id) OVER w AS nt, lead(time_s) OVER w AS ntime FROM tr WINDOW w AS (PARTITION BY operator_id, ran_type ORDER BY time_s, event_id)) "
    f"SELECT event_id, {i('operator_id', 'source_cell_id', 'target_cell_id')}, ran_type FROM n WHERE nt = source_cell_id AND ntime - time_s <= 20000.0",
)
def q_bounce(spark, d):
    t = C.cell_transitions(drive(spark, d), 3600.0, tie="event_id")
    return tidy(C.rapid_bounces(t, 20000.0, tie="event_id").select("event_id", "operator_id", "source_cell_id", "target_cell_id", "ran_type"))


FAULTS = [(n, *row[1:2], *row[3:5]) for n, row in enumerate(A.ANOMALY_ROWS)]


def fault_specs(spark):
    from ..functions.columns import id_list

    t = A.anomaly_truth(spark).withColumn("ord", F.substring("anomaly_id", 3, 3).cast("int"))
    kind = F.col("anomaly_type")
    return t.select(
        "ord", "anomaly_type", "t_start_s", "t_end_s", id_list("affected_ue_ids").alias("ue_ids"), id_list("affected_cell_ids").alias("cell_ids"),
        F.when(kind.isin("rlf_burst", "interference_spike"), F.col("severity")).alias("delta_db"),
        F.when(kind == "slow_degrade", F.col("severity")).alias("rate_db_per_s"),
        F.when(kind == "meas_glitch", F.col("severity")).alias("stuck_value_dbm"),
    )


@query(
    "t10_fault_injection",
    f"""WITH {A.SAMPLES_SQL}, {A.TRUTH_SQL},
h AS (SELECT s.event_id, s.ue_id, s.serving_cell_id, s.time_s, s.rsrp_serving_dbm, t.*, CAST(substr(t.anomaly_id, 3) AS INTEGER) AS ord FROM samples s JOIN truth t ON s.time_s >= a_start AND s.time_s < a_end AND (a_ues IS NULL OR list_contains(a_ues, CAST(s.ue_id AS INTEGER)))),
fz AS (SELECT ue_id, serving_cell_id, ord, arg_min(rsrp_serving_dbm, time_s) AS fz FROM h WHERE anomaly_type = 'meas_glitch' GROUP BY 1, 2, 3),
e AS (SELECT event_id, sum(CASE WHEN anomaly_type = 'rlf_burst' OR (anomaly_type = 'interference_spike' AND (a_cells IS NULL OR list_contains(a_cells, serving_cell_id))) THEN severity END) AS burst,
  sum(CASE WHEN anomaly_type = 'slow_degrade' THEN severity * (time_s - a_start) END) AS ramp FROM h GROUP BY 1),
st AS (SELECT h.event_id, arg_max(coalesce(severity, fz), h.ord) AS stuck FROM h JOIN fz ON fz.ue_id = h.ue_id AND fz.serving_cell_id = h.serving_cell_id AND fz.ord = h.ord WHERE anomaly_type = 'meas_glitch' GROUP BY 1)
SELECT s.event_id, round(coalesce(st.stuck, s.rsrp_serving_dbm), 6) AS rsrp_dbm, round(rsrq_serving_db + coalesce(burst, 0) / 2, 6) AS rsrq_db, round(sinr_serving_db + coalesce(burst, 0) + coalesce(ramp, 0), 6) AS sinr_db
FROM samples s LEFT JOIN e USING (event_id) LEFT JOIN st USING (event_id)""",
)
def q_inject(spark, d):
    t = A.telemetry(spark, d).select(
        "event_id", "ue_id", "time_s", F.col("serving_cell_id").alias("cell_id"), F.col("rsrp_serving_dbm").alias("rsrp_dbm"),
        F.col("rsrq_serving_db").alias("rsrq_db"), F.col("sinr_serving_db").alias("sinr_db"),
    )
    return tidy(C.inject_faults(t, fault_specs(spark)).select("event_id", "rsrp_dbm", "rsrq_db", "sinr_db"))


KINDS = {"HO_ATTEMPT": "n_ho_attempt", "HO_SUCCESS": "n_ho_success", "HO_FAIL": "n_ho_fail", "RLF": "n_rlf", "PING_PONG": "n_ping_pong"}
CK = [f"{m}_{q}" for m in ("rsrp", "sinr") for q in ("p10", "p50", "p90")]


@query(
    "t11_cell_kpis",
    f"""WITH {A.SAMPLES_SQL}, s AS (SELECT serving_cell_id AS cell_id, CAST(floor(time_s / 24.0) AS BIGINT) AS t, avg(rsrp_serving_dbm) AS rsrp_mean, count(DISTINCT ue_id) AS n_ue,
{', '.join(f"quantile_cont({c}, {p}) AS {m}_{q}" for m, c in (('rsrp', 'rsrp_serving_dbm'), ('sinr', 'sinr_serving_db')) for q, p in (('p10', 0.1), ('p50', 0.5), ('p90', 0.9)))} FROM samples GROUP BY 1, 2),
e AS (SELECT neighbor_cell_id AS cell_id, CAST(floor(event_time_s / 24.0) AS BIGINT) AS t, {', '.join(f"count(*) FILTER (event_type = '{k}') AS {c}" for k, c in KINDS.items())} FROM samples GROUP BY 1, 2)
SELECT CAST(coalesce(s.cell_id, e.cell_id) AS BIGINT) AS cell_id, coalesce(s.t, e.t) AS t, {r('rsrp_mean', *CK)}, coalesce(n_ue, 0) AS n_ue, {', '.join(f'coalesce({c}, 0) AS {c}' for c in KINDS.values())},
round(coalesce(n_ho_success, 0) / greatest(coalesce(n_ho_attempt, 0), 1), 6) AS hosr FROM s FULL JOIN e ON s.cell_id = e.cell_id AND s.t = e.t""",
)
def q_cell_kpis(spark, d):
    t = A.telemetry(spark, d)
    return tidy(C.cell_kpis(t, t.withColumn("source_cell_id", F.col("neighbor_cell_id")), 24.0))


def run_rows(spark, d):
    """Orders lines as sweep runs: config and seed from keys, outcomes from flags, signals from prices."""
    li = A.table(spark, d, "lineitem")
    pick = lambda c, n, vals: F.element_at(F.array(*[F.lit(float(v)) for v in vals]), (F.col(c) % n + 1).cast("int"))
    rf = F.col("l_returnflag") == "R"
    kind = (
        F.when((F.col("l_linestatus") == "F") & (F.col("l_discount") > 0.08), "PING_PONG")
        .when(rf, "HO_FAIL").when(F.col("l_quantity") < 4, "RLF").when(F.col("l_quantity") < 25, "HO_ATTEMPT").otherwise("HO_SUCCESS")
    )
    return li.select(
        pick("l_linenumber", 3, (256, 480, 1024)).alias("ttt_ms"), pick("l_suppkey", 4, (0, 2, 4, 6)).alias("hyst_db"), pick("l_partkey", 3, (0, 3, 6)).alias("a3_off_db"),
        (F.col("l_orderkey") % 10).alias("seed"), kind.alias("event_type"),
        (F.col("l_extendedprice") / 1000 - 140).alias("rsrp_dbm"), (F.col("l_quantity") - 20).alias("sinr_db"), (F.col("l_tax") * 100 - 15).alias("rsrq_db"),
    )


RUNS_SQL = """runs AS (SELECT ([256.0, 480.0, 1024.0])[l_linenumber % 3 + 1]::DOUBLE AS ttt_ms, ([0.0, 2.0, 4.0, 6.0])[l_suppkey % 4 + 1]::DOUBLE AS hyst_db, ([0.0, 3.0, 6.0])[l_partkey % 3 + 1]::DOUBLE AS a3_off_db,
l_orderkey % 10 AS seed, CASE WHEN l_linestatus = 'F' AND l_discount > 0.08 THEN 'PING_PONG' WHEN l_returnflag = 'R' THEN 'HO_FAIL' WHEN l_quantity < 4 THEN 'RLF' WHEN l_quantity < 25 THEN 'HO_ATTEMPT' ELSE 'HO_SUCCESS' END AS event_type,
l_extendedprice / 1000 - 140 AS rsrp_dbm, l_quantity - 20 AS sinr_db, l_tax * 100 - 15 AS rsrq_db FROM lineitem)"""


def _mid(c: str, p: float) -> str:
    h = f"greatest(0.0, least(len({c}) - 1, len({c}) * {p} - 0.5))"
    lo, hi = f"{c}[CAST(floor({h}) AS BIGINT) + 1]", f"{c}[CAST(ceil({h}) AS BIGINT) + 1]"
    return f"{lo} + ({hi} - {lo}) * ({h} - floor({h}))"


RK = {"HO_ATTEMPT": "ho_attempt_count", "HO_SUCCESS": "ho_success_count", "HO_FAIL": "ho_fail_count", "RLF": "rlf_count", "PING_PONG": "pp_count"}


@query(
    "t12_run_kpis",
    f"WITH {RUNS_SQL}, g AS (SELECT ttt_ms, hyst_db, a3_off_db, seed, {', '.join(f'''count(*) FILTER (event_type = '{k}') AS {c}''' for k, c in RK.items())}, "
    "list_sort(list(rsrp_dbm)) AS rsrp, list_sort(list(sinr_db)) AS sinr, list_sort(list(rsrq_db)) AS rsrq FROM runs GROUP BY ALL) "
    f"SELECT {r('ttt_ms', 'hyst_db', 'a3_off_db')}, seed, {', '.join(RK.values())}, "
    + ", ".join(f"round({_mid(m, p)}, 6) AS {m}_{q}_{u}" for m, u in (("rsrp", "dbm"), ("sinr", "db"), ("rsrq", "db")) for q, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))
    + ", round(ho_success_count / nullif(ho_attempt_count, 0), 6) AS hosr, round(ho_fail_count / nullif(ho_attempt_count, 0), 6) AS hofr_rate, "
    "round(pp_count / nullif(ho_attempt_count, 0), 6) AS ping_pong_rate, round(rlf_count / 600.0, 6) AS rlf_rate FROM g",
)
def q_runs(spark, d):
    return tidy(C.run_kpis(run_rows(spark, d), ["ttt_ms", "hyst_db", "a3_off_db", "seed"], 10, 60.0))


@query(
    "t13_mean_ratio_grid",
    f"WITH {RUNS_SQL}, g AS (SELECT ttt_ms, hyst_db, seed, count(*) FILTER (event_type = 'HO_ATTEMPT') AS a, count(*) FILTER (event_type = 'HO_SUCCESS') AS s FROM runs GROUP BY ALL), "
    "m AS (SELECT ttt_ms, hyst_db, avg(s) / greatest(avg(a), 1.0) AS v FROM g GROUP BY 1, 2) SELECT round(ttt_ms, 6) AS ttt_ms, "
    + ", ".join(f"round(max(v) FILTER (hyst_db = {h}.0), 6) AS h{h}" for h in (0, 2, 4, 6))
    + " FROM m GROUP BY 1",
)
def q_ratio_grid(spark, d):
    runs = C.run_kpis(run_rows(spark, d), ["ttt_ms", "hyst_db", "seed"], 10, 60.0)
    g = C.mean_ratio_grid(runs, "ttt_ms", "hyst_db", [0.0, 2.0, 4.0, 6.0])
    return tidy(g.withColumnsRenamed({f"{h}.0": f"h{h}" for h in (0, 2, 4, 6)}))


@query(
    "t14_event_enrichment",
    f"""WITH {A.SAMPLES_SQL}, e AS (SELECT event_id, ue_id, event_time_s FROM samples WHERE event_type = 'HO_SUCCESS'), s AS (SELECT ue_id, time_s, rsrp_serving_dbm, sinr_serving_db FROM samples),
p AS (SELECT e.event_id, s.rsrp_serving_dbm AS a, s.sinr_serving_db AS b FROM e ASOF LEFT JOIN s ON e.ue_id = s.ue_id AND e.event_time_s > s.time_s),
q AS (SELECT e.event_id, s.rsrp_serving_dbm AS a, s.sinr_serving_db AS b FROM e ASOF LEFT JOIN s ON e.ue_id = s.ue_id AND e.event_time_s < s.time_s)
SELECT event_id, round(p.a, 6) AS pre_rsrp_serving_dbm, round(p.b, 6) AS pre_sinr_serving_db, round(q.a, 6) AS post_rsrp_serving_dbm, round(q.b, 6) AS post_sinr_serving_db FROM p JOIN q USING (event_id)""",
)
def q_enrich(spark, d):
    t = A.telemetry(spark, d)
    e = t.where("event_type = 'HO_SUCCESS'").select("event_id", "ue_id", "event_time_s")
    out = C.enrich_events(e, t.select("ue_id", "time_s", "rsrp_serving_dbm", "sinr_serving_db"), ["rsrp_serving_dbm", "sinr_serving_db"], chunk=24.0)
    return tidy(out.drop("ue_id", "event_time_s"))
