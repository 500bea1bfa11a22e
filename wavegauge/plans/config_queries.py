"""Configuration sweep, surrogate, inverse query, interventions and adaptive replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptive as AD
from ..operators import inverse as I
from ..operators import labels as L
from ..operators import ranking as M
from ..operators import surrogate as S
from ..operators.control import run_kpis
from ..operators.drift import run_sequential
from ..operators.scorers import PcaScorer
from ..operators.windows import feature_columns
from ..functions.detectors import Adwin, PageHinkley
from ..session import materialise
from . import adapter as A
from .control_queries import RK, RUNS_SQL, _mid, run_rows
from .drift_queries import BITS_SQL, STREAM_SQL, streams
from .registry import i, query, r, tidy
from .window_queries import labelled

CFG = ", ".join(S.CONTROLLED)
SWEEP_SQL = f"""{RUNS_SQL}, g AS (SELECT {CFG}, seed, {', '.join(f"count(*) FILTER (event_type = '{k}') AS {c}" for k, c in RK.items())},
list_sort(list(rsrp_dbm)) AS rsrp, list_sort(list(sinr_db)) AS sinr, list_sort(list(rsrq_db)) AS rsrq FROM runs GROUP BY ALL),
sweep AS (SELECT {CFG}, seed, ho_success_count / greatest(ho_success_count + ho_fail_count, 1) AS hosr, 1.0 - ho_success_count / greatest(ho_success_count + ho_fail_count, 1) AS hofr_rate,
rlf_count / 600.0::DOUBLE AS rlf_rate, pp_count / greatest(ho_attempt_count, 1) AS ping_pong_rate,
{', '.join(f"{_mid(m, p)} AS {m}_{q}_{u}" for m, u in (('rsrp', 'dbm'), ('sinr', 'db'), ('rsrq', 'db')) for q, p in (('p10', 0.1), ('p50', 0.5), ('p90', 0.9)))} FROM g)"""


def sweep(spark, d):
    k = run_kpis(run_rows(spark, d), [*S.CONTROLLED, "seed"], 10, 60.0)
    s, f, a = F.col("ho_success_count"), F.col("ho_fail_count"), F.col("ho_attempt_count")
    hosr = s / F.greatest(s + f, F.lit(1))
    k = k.withColumns({"hosr": hosr, "hofr_rate": 1.0 - hosr, "ping_pong_rate": F.col("pp_count") / F.greatest(a, F.lit(1))})
    return materialise(S.check_sweep(k.select(*S.FEATURES, "seed", *S.TARGETS, "hofr_rate")), "sweep")


@query("c01_sweep_table", f"WITH {SWEEP_SQL} SELECT {r(*S.FEATURES, *S.TARGETS, 'hofr_rate')}, seed FROM sweep")
def q_sweep(spark, d):
    return tidy(sweep(spark, d))


@query("c02_redundancy", f"WITH {SWEEP_SQL} SELECT round(max(abs(hosr + hofr_rate - 1.0)), 6) AS worst, count(*) FILTER (abs(hosr + hofr_rate - 1.0) > 1e-6) AS n_bad, count(*) AS n FROM sweep")
def q_redundancy(spark, d):
    s = sweep(spark, d)
    S.assert_redundant(s)
    return tidy(S.redundancy_report(s))


FOLD_SQL = f"""sz AS (SELECT {CFG}, count(*) AS n FROM sweep GROUP BY ALL),
fold AS (SELECT {CFG}, (row_number() OVER (ORDER BY n DESC, {CFG}) - 1) % 5 AS fold FROM sz)"""


@query("c03_grouped_folds", f"WITH {SWEEP_SQL}, {FOLD_SQL} SELECT {r(*S.CONTROLLED)}, seed, CAST(fold AS BIGINT) AS fold FROM sweep JOIN fold USING ({CFG})")
def q_folds(spark, d):
    return tidy(S.grouped_folds(sweep(spark, d)).select(*S.CONTROLLED, "seed", "fold"))


@query("c04_candidate_grid", f"WITH {RUNS_SQL} SELECT DISTINCT {r(*S.CONTROLLED)} FROM runs")
def q_grid(spark, d):
    return tidy(S.candidate_grid(spark, run_rows(spark, d)))


@query("c13_median_context", f"WITH {SWEEP_SQL} SELECT {', '.join(f'round(quantile_cont({c}, 0.5), 6) AS {c}' for c in S.CONTEXT)} FROM sweep")
def q_median(spark, d):
    return tidy(S.median_context(sweep(spark, d)))


# A transparent surrogate: the same expressions run on both engines.
EXPR = {
    "hosr": "0.5 + 0.0002 * ttt_ms - 0.01 * hyst_db + 0.005 * a3_off_db + 0.001 * (rsrp_p50_dbm + 90.0)",
    "rlf_rate": "0.02 + 0.00001 * ttt_ms + 0.002 * hyst_db - 0.0005 * sinr_p50_db",
    "ping_pong_rate": "0.2 - 0.0001 * ttt_ms - 0.01 * hyst_db + 0.002 * rsrq_p50_db",
}
LIMITS = [I.Constraint("hosr", ">=", 0.55), I.Constraint("rlf_rate", "<=", 0.05), I.Constraint("ping_pong_rate", "<", 0.15)]
PRED_SQL = ", ".join(f"CAST({e} AS DOUBLE) AS {t}" for t, e in EXPR.items())
OK_SQL = " AND ".join(f"{c.target} {c.op} {c.value}" for c in LIMITS)
INV_SQL = f"""{SWEEP_SQL}, gridc AS (SELECT DISTINCT {CFG} FROM sweep),
ctx AS (SELECT seed AS context_id, {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in S.CONTEXT)} FROM sweep GROUP BY 1),
cand AS (SELECT *, {PRED_SQL} FROM ctx, gridc),
inv AS (SELECT *, {OK_SQL} AS feasible, row_number() OVER (PARTITION BY context_id ORDER BY ({OK_SQL}) DESC, hosr DESC, {CFG}) AS rank,
  count(*) FILTER ({OK_SQL}) OVER (PARTITION BY context_id) AS n_feasible FROM cand)"""


def contexts(spark, d):
    from ..operators.scale import grouped_quantiles

    s = sweep(spark, d)
    q = grouped_quantiles(s, ["seed"], {c: {f"{c}__m": 0.5} for c in S.CONTEXT})
    return s, q.select(F.col("seed").alias("context_id"), *[F.col(f"{c}__m").alias(c) for c in S.CONTEXT])


@query("c11_inverse_query", f"WITH {INV_SQL} SELECT context_id, {r(*S.CONTROLLED, *S.TARGETS)}, feasible, rank, n_feasible FROM inv")
def q_inverse(spark, d):
    s, c = contexts(spark, d)
    out = I.inverse_query(c, S.candidate_grid(spark, s), S.ExpressionSurrogate(EXPR), LIMITS)
    return tidy(out.select("context_id", *S.CONTROLLED, *S.TARGETS, "feasible", "rank", "n_feasible"))


@query("c10_constraints", f"WITH {INV_SQL} SELECT context_id, count(*) FILTER (hosr >= 0.55) AS ge, count(*) FILTER (hosr > 0.6) AS gt, count(*) FILTER (rlf_rate <= 0.03) AS le, count(*) FILTER (rlf_rate < 0.025) AS lt FROM inv GROUP BY 1")
def q_constraints(spark, d):
    s, c = contexts(spark, d)
    out = I.inverse_query(c, S.candidate_grid(spark, s), S.ExpressionSurrogate(EXPR))
    specs = {"ge": ("hosr", ">=", 0.55), "gt": ("hosr", ">", 0.6), "le": ("rlf_rate", "<=", 0.03), "lt": ("rlf_rate", "<", 0.025)}
    return tidy(out.groupBy("context_id").agg(*[F.count(F.when(I.Constraint(*v).column(), 1)).alias(k) for k, v in specs.items()]))


@query(
    "c12_pareto_front",
    "WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS a, l_discount AS b, l_quantity AS c FROM lineitem), f AS (SELECT DISTINCT a, b, c FROM p x WHERE NOT EXISTS (SELECT 1 FROM (SELECT b, c, max(a) AS a FROM p GROUP BY 1, 2) y "
    "WHERE y.a >= x.a AND y.b <= x.b AND y.c <= x.c AND (y.a > x.a OR y.b < x.b OR y.c < x.c))) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM p SEMI JOIN f USING (a, b, c)",
)
def q_pareto(spark, d):
    li = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("a"), F.col("l_discount").alias("b"), F.col("l_quantity").alias("c"))
    return tidy(I.pareto_front(li, [("a", "max"), ("b", "min"), ("c", "min")]))


MD = lambda k: f"(('0x' || substr(md5({k}), 1, 8))::UBIGINT % 10000)"
CONF_SQL = f"""{RUNS_SQL}, cx AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS y, {MD("'calibration|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey")} < 2500 AS held FROM lineitem),
iv AS (SELECT q, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM cx WHERE NOT held GROUP BY 1),
e AS (SELECT greatest(lo - y, y - hi) AS e FROM cx JOIN iv USING (q) WHERE held), n AS (SELECT count(*) AS n FROM e)"""


@query("c07_conformal_margin", f"WITH {CONF_SQL}, l AS (SELECT list_sort(list(e)) AS v, any_value(least(1.0::DOUBLE, ceil((n + 1) * (0.9::DOUBLE - 0.1::DOUBLE)) / n)) * (count(*) - 1) AS h FROM e, n) SELECT round(v[CAST(floor(h) AS BIGINT) + 1] + (v[CAST(ceil(h) AS BIGINT) + 1] - v[CAST(floor(h) AS BIGINT) + 1]) * (h - floor(h)), 4) AS margin, len(v) AS n_calibration FROM l")
def q_conformal(spark, d):
    from ..operators.scale import grouped_quantiles

    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    x = A.table(spark, d, "lineitem").select(*key, F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("y"))
    x = x.withColumn("held", S.share(key, "calibration") < 2500)
    iv = materialise(grouped_quantiles(x.where("NOT held"), ["q"], {"y": {"lo": 0.1, "hi": 0.9}}), "intervals")
    return tidy(S.conformal_margin(x.where("held").join(iv, "q"), "y", "lo", "hi", 0.9 - 0.1), 4)


REG_SQL = f"""{SWEEP_SQL}, {FOLD_SQL}, pr AS (SELECT s.*, f.fold, (SELECT 0) AS z FROM sweep s JOIN fold f USING ({CFG})),
mu AS (SELECT a.fold AS fold, avg(b.hosr) AS hosr, avg(b.rlf_rate) AS rlf_rate FROM (SELECT DISTINCT fold FROM fold) a JOIN pr b ON b.fold <> a.fold GROUP BY 1),
lg AS (SELECT 'hosr' AS target, p.fold, p.hosr AS actual, mu.hosr + 0.0001 * (p.ttt_ms - 500.0) AS predicted FROM pr p JOIN mu USING (fold) UNION ALL
  SELECT 'rlf_rate', p.fold, p.rlf_rate, mu.rlf_rate FROM pr p JOIN mu USING (fold))"""


def fold_predictions(spark, d):
    """Out-of-fold means as a simple point model."""
    f = materialise(S.grouped_folds(sweep(spark, d)), "folds")
    names = ["hosr", "rlf_rate"]
    tot = f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names])
    whole = tot.agg(F.sum("n").alias("all_rows"), *[F.sum(c).alias(f"S_{c}") for c in names])
    mu = tot.crossJoin(F.broadcast(whole)).select("fold", *[((F.col(f"S_{c}") - F.col(c)) / (F.col("all_rows") - F.col("n"))).alias(f"mu_{c}") for c in names])
    j = f.join(F.broadcast(mu), "fold")
    a = j.select(F.lit("hosr").alias("target"), "fold", F.col("hosr").alias("actual"), (F.col("mu_hosr") + 0.0001 * (F.col("ttt_ms") - 500.0)).alias("predicted"))
    return a.unionByName(j.select(F.lit("rlf_rate").alias("target"), "fold", F.col("rlf_rate").alias("actual"), F.col("mu_rlf_rate").alias("predicted")))


SC = "count(*) AS n, avg(abs(actual - predicted)) AS mae, sqrt(avg(pow(actual - predicted, 2))) AS rmse, CASE WHEN var_pop(actual) > 0 THEN 1 - avg(pow(actual - predicted, 2)) / var_pop(actual) END AS r2"


@query("m16_regression_scores", f"WITH {REG_SQL}, s AS (SELECT target, fold, {SC} FROM lg GROUP BY 1, 2) SELECT target, CAST(fold AS BIGINT) AS fold, n, {r('mae', 'rmse', 'r2')} FROM s")
def q_reg(spark, d):
    return tidy(M.regression_scores(fold_predictions(spark, d), ["target", "fold"]))


@query(
    "m18_cv_aggregates",
    f"WITH {REG_SQL}, s AS (SELECT target, fold, {SC} FROM lg GROUP BY 1, 2) SELECT target, count(DISTINCT fold) AS n_folds, {', '.join(f'round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std' for c in ('mae', 'rmse', 'r2'))} FROM s GROUP BY 1",
)
def q_cv(spark, d):
    return tidy(S.aggregate_cv(fold_predictions(spark, d)))


@query(
    "m17_interval_coverage",
    "WITH x AS (SELECT l_quantity AS q, l_extendedprice AS y, l_orderkey % 2 AS h FROM lineitem), "
    "iv AS (" + " UNION ALL ".join(f"SELECT q, {n}::DOUBLE AS nominal, quantile_cont(y, {a}) AS lo, quantile_cont(y, {b}) AS hi FROM x WHERE h = 0 GROUP BY 1" for n, a, b in ((0.5, 0.25, 0.75), (0.8, 0.1, 0.9), (0.9, 0.05, 0.95))) + ") "
    "SELECT round(nominal, 6) AS nominal, count(*) AS n, round(avg(CAST(y BETWEEN lo AND hi AS INTEGER)), 6) AS coverage, round(avg(hi - lo), 4) AS mean_width FROM x JOIN iv USING (q) WHERE h = 1 GROUP BY 1",
)
def q_coverage(spark, d):
    from ..operators.scale import grouped_quantiles

    levels = {0.5: (0.25, 0.75), 0.8: (0.1, 0.9), 0.9: (0.05, 0.95)}
    M.check_nominal(list(levels))
    x = A.table(spark, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("y"), (F.col("l_orderkey") % 2).alias("h"))
    spec = {"y": {f"{s}{int(n * 100)}": p[k] for n, p in levels.items() for k, s in enumerate(("lo", "hi"))}}
    iv = grouped_quantiles(x.where("h = 0"), ["q"], spec)
    rows = F.array(*[F.struct(F.lit(n).alias("nominal"), F.col(f"lo{int(n * 100)}").alias("low"), F.col(f"hi{int(n * 100)}").alias("high")) for n in levels])
    j = x.where("h = 1").join(iv.select("q", F.explode(rows).alias("_r")), "q").select(F.col("y").alias("actual"), "_r.*")
    out = M.interval_coverage(j, [])
    return tidy(out).withColumn("mean_width", F.round("mean_width", 4))


# --- trained surrogates: rows only -------------------------------------------------------------


def _boost():
    return S.BoostedRegressor(iterations=8, rate=0.3, depth=4)


@query("c05_boosted_cv")
def q_boost(spark, d):
    f = materialise(S.grouped_folds(sweep(spark, d), 3), "folds")
    return tidy(S.aggregate_cv(S.cv_points(f, _boost, "hosr", 3)))


@query("c06_quantile_forest")
def q_forest(spark, d):
    s = sweep(spark, d)
    m = S.QuantileForest(trees=10).fit(s, "hosr")
    return tidy(m.predict_interval(s).select(*S.CONTROLLED, "seed", "hosr_lo", "hosr", "hosr_hi"))


@query("c09_interval_cv")
def q_icv(spark, d):
    f = materialise(S.grouped_folds(sweep(spark, d), 3), "folds")
    parts = []
    for variant, make in (("naive", lambda: S.QuantileForest(trees=10)), ("conformal", lambda: S.ConformalForest(trees=10))):
        parts.append(S.aggregate_cv_coverage(S.cv_intervals(f, make, "hosr", 0.8, 3)).withColumn("variant", F.lit(variant)))
    return tidy(parts[0].unionByName(parts[1]))


@query("c14_surrogate_verdicts")
def q_c14(spark, d):
    f = materialise(S.grouped_folds(sweep(spark, d), 3), "folds")
    pts = S.aggregate_cv(fold_predictions(spark, d))
    cov = S.aggregate_cv_coverage(S.cv_intervals(f, lambda: S.ConformalForest(trees=10), "hosr", 0.8, 3))
    s, c = contexts(spark, d)
    inv = I.inverse_query(c, S.candidate_grid(spark, s), S.ExpressionSurrogate(EXPR), LIMITS).select("n_feasible")
    return tidy(S.surrogate_verdicts(pts, cov, inv, n_targets=2))


# --- interventions -----------------------------------------------------------------------------

LOG_SQL = "log(t_s, reason) AS (SELECT time_s + 0.25, 'drift:' || list_aggregate(list_sort(list(DISTINCT stream_name)), 'string_agg', ',') FROM zs WHERE z >= 3.2 GROUP BY time_s UNION ALL SELECT 30.0, 'warmup')"
TRIG_SQL = f"{STREAM_SQL}, {BITS_SQL}, {LOG_SQL}, trig AS (SELECT t_s, substr(reason, 7) AS drift_streams_fired FROM log WHERE reason LIKE 'drift:%')"


def retrain_log(spark, d):
    from ..operators.drift import binarise

    b = binarise(streams(spark, d), z=3.2).where("error = 1")
    t = b.groupBy((F.col("time_s") + 0.25).alias("t_s")).agg(F.concat(F.lit("drift:"), F.array_join(F.array_sort(F.collect_set("stream_name")), ",")).alias("reason"))
    return materialise(t.unionByName(spark.createDataFrame([(30.0, "warmup")], "t_s double, reason string")), "log")


@query("i04_drift_triggers", f"WITH {TRIG_SQL} SELECT {r('t_s')}, drift_streams_fired FROM trig")
def q_triggers(spark, d):
    return tidy(I.drift_triggers(retrain_log(spark, d)))


CTX_Q = ", ".join(
    f"quantile_cont({c}, {p}) AS {m}_{q}_{u}"
    for c, m, u in (("rsrp_serving_dbm", "rsrp", "dbm"), ("sinr_serving_db", "sinr", "db"), ("rsrq_serving_db", "rsrq", "db"))
    for q, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))
)
CTX_SQL = f"{TRIG_SQL}, ctx AS (SELECT t.t_s, any_value(drift_streams_fired) AS drift_streams_fired, count(s.time_s) AS context_n_samples, {CTX_Q} FROM trig t LEFT JOIN samples s ON s.time_s >= t.t_s - 12.0 AND s.time_s <= t.t_s GROUP BY 1)"


@query("i01_deployment_context", f"WITH {CTX_SQL} SELECT {r('t_s', *S.CONTEXT)}, context_n_samples FROM ctx")
def q_context(spark, d):
    t = I.drift_triggers(retrain_log(spark, d))
    return tidy(I.deployment_context(A.telemetry(spark, d), t, 12.0).select("t_s", *S.CONTEXT, "context_n_samples"))


CFG_SQL = f"{CTX_SQL}, cur AS (SELECT c.*, e.cfg_ttt_ms AS current_ttt_ms, e.cfg_hyst_db AS current_hyst_db, e.cfg_a3_off_db AS current_a3_off_db FROM ctx c ASOF LEFT JOIN samples e ON e.event_time_s <= c.t_s)"


@query("i02_config_in_force", f"WITH {CFG_SQL} SELECT {r('t_s', 'current_ttt_ms', 'current_hyst_db', 'current_a3_off_db')} FROM cur")
def q_current(spark, d):
    t = I.drift_triggers(retrain_log(spark, d))
    return tidy(I.config_in_force(t, A.telemetry(spark, d), chunk=24.0).drop("drift_streams_fired"))


@query("i03_phase_configs", f"WITH {A.SAMPLES_SQL} SELECT {i('phase_id')}, count(*) AS n_events, round(min(event_time_s), 6) AS t_min_s, round(max(event_time_s), 6) AS t_max_s, round(arg_min(cfg_ttt_ms, event_time_s), 6) AS ttt_ms, round(arg_min(cfg_hyst_db, event_time_s), 6) AS hyst_db, round(arg_min(cfg_a3_off_db, event_time_s), 6) AS a3_off_db FROM samples GROUP BY 1")
def q_phase_cfg(spark, d):
    return tidy(I.phase_configs(A.telemetry(spark, d)))


CUR = ", ".join(f"current_{c} AS {c}" for c in S.CONTROLLED)
REC_SQL = f"""{CFG_SQL}, gridc AS (SELECT * FROM (VALUES {', '.join(f'({t}::DOUBLE, {h}::DOUBLE, {a}::DOUBLE)' for t in S.CANONICAL['ttt_ms'] for h in S.CANONICAL['hyst_db'] for a in S.CANONICAL['a3_off_db'])}) g({CFG})),
cand AS (SELECT *, {PRED_SQL} FROM cur, gridc WHERE current_ttt_ms IS NOT NULL AND context_n_samples > 0),
rk AS (SELECT *, {OK_SQL} AS feasible, row_number() OVER (PARTITION BY t_s ORDER BY ({OK_SQL}) DESC, hosr DESC, {CFG}) AS rank, count(*) FILTER ({OK_SQL}) OVER (PARTITION BY t_s) AS n_feasible, count(*) OVER (PARTITION BY t_s) AS n_candidates FROM cand),
nowp AS (SELECT t_s, {', '.join(f'CAST({e} AS DOUBLE) AS now_{t}' for t, e in EXPR.items())} FROM (SELECT t_s, {CUR}, {', '.join(S.CONTEXT)} FROM cur)),
rec AS (SELECT r.t_s AS t_trigger_s, drift_streams_fired, n_feasible, n_candidates, abs(ttt_ms - current_ttt_ms) > 1e-9 OR abs(hyst_db - current_hyst_db) > 1e-9 OR abs(a3_off_db - current_a3_off_db) > 1e-9 AS cfg_changed,
context_n_samples, current_ttt_ms, current_hyst_db, current_a3_off_db, ttt_ms AS recommended_ttt_ms, hyst_db AS recommended_hyst_db, a3_off_db AS recommended_a3_off_db,
{', '.join(f'now_{t} AS pred_current_{t}, {t} AS pred_recommended_{t}' for t in S.TARGETS)}, hosr - now_hosr AS signed_uplift_hosr, now_rlf_rate - rlf_rate AS signed_uplift_rlf_rate, now_ping_pong_rate - ping_pong_rate AS signed_uplift_ping_pong_rate FROM rk r JOIN nowp USING (t_s) WHERE rank = 1)"""
RECS = ["t_trigger_s", *[f"{p}_{c}" for p in ("current", "recommended") for c in S.CONTROLLED], *[f"{p}_{t}" for p in ("pred_current", "pred_recommended", "signed_uplift") for t in S.TARGETS]]


def records(spark, d):
    t = I.drift_triggers(retrain_log(spark, d))
    tele = A.telemetry(spark, d)
    grid = S.candidate_grid(spark)
    return I.interventions(t, tele, tele, grid, S.ExpressionSurrogate(EXPR), LIMITS, window=12.0, chunk=24.0), grid


@query("i05_interventions", f"WITH {REC_SQL} SELECT {r(*RECS)}, drift_streams_fired, n_feasible, n_candidates, cfg_changed, context_n_samples FROM rec")
def q_records(spark, d):
    return tidy(records(spark, d)[0].select(*RECS, "drift_streams_fired", "n_feasible", "n_candidates", "cfg_changed", "context_n_samples"))


@query("i07_cumulative_uplift", f"WITH {REC_SQL} SELECT {r('t_trigger_s')}, " + ", ".join(f"round(sum(signed_uplift_{t}) OVER (ORDER BY t_trigger_s), 6) AS cum_uplift_{t}" for t in S.TARGETS) + " FROM rec")
def q_cum(spark, d):
    return tidy(I.cumulative_uplift(records(spark, d)[0]))


@query(
    "i08_intervention_verdicts",
    f"WITH {REC_SQL}, {A.DRIFT_SQL}, nr AS (SELECT t_trigger_s, cfg_changed FROM rec WHERE EXISTS (SELECT 1 FROM drift WHERE drift_id = 'D-4' AND t_trigger_s >= start_time_s - 5.0 AND t_trigger_s <= end_time_s + 60.0)) "
    "SELECT 'D2' AS code, count(*) >= 5 AS passed FROM rec UNION ALL SELECT 'D3', count(*) > 0 FROM rec UNION ALL SELECT 'D4', count(*) > 0 AND count(*) = count(*) FILTER (cfg_changed) FROM nr UNION ALL SELECT 'D5', coalesce(sum(signed_uplift_hosr) > 0, false) FROM rec",
)
def q_verdicts(spark, d):
    rec, grid = records(spark, d)
    return tidy(I.intervention_verdicts(materialise(rec, "records"), A.drift_truth(spark), grid))


# --- adaptive replay ---------------------------------------------------------------------------

FEATS = feature_columns()
KEY = ["ue_id", "phase_id", "window_id"]
POST = "post AS (SELECT DISTINCT t_end_s FROM lab WHERE phase_id > 3)"


@query(
    "a02_periodic_epochs",
    f"WITH RECURSIVE {A.labelled_sql()}, {POST}, ep AS (SELECT min(t_end_s) AS t, 0 AS k FROM post UNION ALL SELECT (SELECT min(p.t_end_s) FROM post p WHERE p.t_end_s - ep.t >= 48.0), k + 1 FROM ep WHERE EXISTS (SELECT 1 FROM post p WHERE p.t_end_s - ep.t >= 48.0)) "
    "SELECT round(t, 6) AS t_s, 'periodic:48s' AS reason FROM ep WHERE k > 0",
)
def q_periodic(spark, d):
    w = labelled(spark, d).where("phase_id > 3")
    return tidy(AD.Periodic(48.0).epochs(w, None))


SIG_SQL = f"""{A.labelled_sql()}, {POST}, {STREAM_SQL.replace(A.SAMPLES_SQL, '').lstrip().lstrip(',')}, {BITS_SQL},
fr AS (SELECT stream_name, time_s FROM zs WHERE z >= 2.5 AND time_s > 72.0),
sig AS (SELECT p.t_end_s AS t_s, list_aggregate(list_sort(list(DISTINCT f.stream_name)), 'string_agg', ',') AS streams FROM fr f ASOF JOIN post p ON p.t_end_s >= f.time_s GROUP BY 1)"""


def signals(spark, d):
    from ..operators.drift import binarise

    w = materialise(labelled(spark, d).where("phase_id > 3").select("t_end_s"), "ends")
    f = binarise(streams(spark, d), z=2.5).where("error = 1 AND time_s > 72.0")
    return w, materialise(AD.decision_signals(w, f, chunk=24.0), "signals")


@query("a05_decision_signals", f"WITH {SIG_SQL} SELECT {r('t_s')}, streams FROM sig")
def q_signals(spark, d):
    s = signals(spark, d)[1]
    return tidy(s.select("t_s", F.array_join("streams", ",").alias("streams")))


@query(
    "a03_drift_epochs",
    f"WITH RECURSIVE {SIG_SQL}, ep AS (SELECT min(t_s) AS t FROM sig UNION ALL SELECT (SELECT min(s.t_s) FROM sig s WHERE s.t_s - ep.t >= 12.0 AND s.t_s > ep.t) FROM ep WHERE EXISTS (SELECT 1 FROM sig s WHERE s.t_s - ep.t >= 12.0 AND s.t_s > ep.t)) "
    "SELECT round(e.t, 6) AS t_s, 'drift:' || s.streams AS reason FROM ep e JOIN sig s ON s.t_s = e.t",
)
def q_drift_epochs(spark, d):
    w, s = signals(spark, d)
    return tidy(AD.DriftTriggered(12.0).epochs(w, s))


@query("a01_static_epochs", f"WITH {A.labelled_sql()}, {POST} SELECT 0 AS n_epochs, count(*) AS n_decisions FROM post")
def q_static(spark, d):
    w = labelled(spark, d).where("phase_id > 3")
    e = AD.Static().epochs(w, None).agg(F.count(F.lit(1)).alias("n_epochs"))
    return tidy(e.crossJoin(F.broadcast(w.agg(F.countDistinct("t_end_s").alias("n_decisions")))))


@query(
    "a06_retrain_pools",
    f"WITH RECURSIVE {A.labelled_sql()}, {POST}, ep AS (SELECT min(t_end_s) AS t, 0 AS k FROM post UNION ALL SELECT (SELECT min(p.t_end_s) FROM post p WHERE p.t_end_s - ep.t >= 48.0), k + 1 FROM ep WHERE EXISTS (SELECT 1 FROM post p WHERE p.t_end_s - ep.t >= 48.0)) "
    "SELECT round(e.t, 6) AS t_s, count(*) AS n, CAST(sum(label_anomaly) AS BIGINT) AS n_pos FROM ep e JOIN lab l ON l.t_end_s <= e.t AND l.t_end_s > e.t - 24.0 WHERE k > 0 GROUP BY 1",
)
def q_pools(spark, d):
    w = materialise(labelled(spark, d), "windows")
    e = AD.Periodic(48.0).epochs(w.where("phase_id > 3"), None)
    p = AD.retrain_pools(w, e, 24.0)
    return tidy(p.groupBy("t_s").agg(F.count(F.lit(1)).alias("n"), F.sum("label_anomaly").alias("n_pos")))


def replay_all(spark, d):
    w = materialise(labelled(spark, d), "windows")
    fired = materialise(run_sequential(streams(spark, d), {"ADWIN": lambda: Adwin(0.5, clock=8), "PH": lambda: PageHinkley(threshold=30.0)}), "firings")
    parts, logs = [], []
    for name, strategy, q in AD.default_runs(period=240.0, cooldown=168.0):
        s, g = AD.replay(w, fired, strategy, PcaScorer, FEATS, KEY, pool_window=72.0, filter_quantile=q, chunk=24.0, name=name)
        parts.append(s.select("strategy", *KEY, "t_mid_s", "label_anomaly", "score"))
        logs.append(g)
    scored, log = parts[0], logs[0]
    for s, g in zip(parts[1:], logs[1:]):
        scored, log = scored.unionByName(s), log.unionByName(g)
    return w, materialise(scored, "replay"), log


@query("a10_adaptive_replay")
def q_replay(spark, d):
    w, scored, log = replay_all(spark, d)
    phases = L.drift_phases(w, A.drift_truth(spark))
    s = materialise(AD.run_summary(scored, log, phases), "summary")
    v = AD.adaptive_verdicts(s)
    packed = v.agg(F.max(F.when(F.col("code") == "C2", F.col("passed"))).alias("c2_pass"), F.max(F.when(F.col("code") == "C3", F.col("passed"))).alias("c3_pass"))
    return tidy(s.drop("cost__fit_cpu_s_sum", "cost__fit_cpu_s_mean").crossJoin(F.broadcast(packed)))


@query(
    "m15_cost_ledger",
    "WITH l AS (SELECT o_orderpriority AS strategy, (epoch_us(o_orderdate) - 694224000000000) / 86400000000.0 AS t_s, CASE WHEN o_orderkey % 10 = 0 THEN 'warmup' ELSE 'drift:x' END AS reason, o_custkey AS n, o_totalprice / 1e6 AS c FROM orders) "
    "SELECT strategy, count(*) AS n_refits, CAST(sum(n) AS BIGINT) AS n_train_samples_sum, round(sum(c), 4) AS fit_cpu_s_sum, round(avg(c), 4) AS fit_cpu_s_mean, round(avg(n), 4) AS n_train_samples_mean, round(min(t_s) FILTER (reason <> 'warmup'), 4) AS first_refit_t_s FROM l GROUP BY 1",
)
def q_ledger(spark, d):
    days = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1992-01-01 00:00:00', o_orderdate)") / F.lit(86400000000.0)
    log = A.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("strategy"), days.alias("t_s"), F.when(F.col("o_orderkey") % 10 == 0, "warmup").otherwise("drift:x").alias("reason"),
        F.col("o_custkey").alias("n_train_samples"), (F.col("o_totalprice") / 1e6).alias("fit_cpu_s"),
    )
    return tidy(M.cost_ledger(log, ["strategy"]), 4)
