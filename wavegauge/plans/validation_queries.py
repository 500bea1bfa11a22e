"""Sinks, upserts, run summaries and cross-run validation over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validate as V
from ..session import fresh_path, materialise
from ..sources import artefacts as S
from . import adapter as A
from .registry import query, r, tidy

# Runs are customer nations: their order statistics stand in for pipeline results.
RUNS_SQL = """
st AS (SELECT c_nationkey AS run, count(*) AS n, avg(o_totalprice) AS p, count(*) FILTER (o_orderstatus = 'F') AS nf,
  avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') / 1e6 AS pf, avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') / 1e6 AS pn FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
wn AS (SELECT *, CASE WHEN run % 5 = 0 THEN 'LOF' ELSE 'IsoForest' END AS w FROM st),
m AS (
  SELECT run, 'anomaly__winning_detector_per_type_mean' AS metric, NULL::DOUBLE AS num, w AS txt, 'text' AS kind FROM wn UNION ALL
  SELECT run, 'anomaly__winning_detector', NULL, w, 'text' FROM wn UNION ALL SELECT run, 'anomaly__winning_detector_overall', NULL, CASE WHEN run % 2 = 0 THEN 'PCA-AE' ELSE 'LOF' END, 'text' FROM wn UNION ALL
  SELECT run, 'anomaly__elapsed_s', p / 1000, NULL, 'number' FROM wn UNION ALL
  SELECT run, 'drift__winning_detector', NULL, 'ADWIN', 'text' FROM wn WHERE run <> 7 UNION ALL SELECT run, 'drift__n_detections', nf, NULL, 'number' FROM wn WHERE run <> 7 UNION ALL
  SELECT run, 'drift__n_drifts', 8, NULL, 'number' FROM wn WHERE run <> 7 UNION ALL SELECT run, 'drift__elapsed_s', NULL, NULL, 'number' FROM wn WHERE run <> 7 UNION ALL
  SELECT run, 'drift__missing', 1, NULL, 'bool' FROM wn WHERE run = 7 UNION ALL
  SELECT run, 'adaptive__' || s || '__' || k, CASE k WHEN 'n_refits' THEN 8 WHEN 'fit_cpu_s_sum' THEN NULL WHEN 'overall_pr_auc' THEN 0.1 ELSE CASE s WHEN 'drift_triggered_filtered' THEN pf WHEN 'drift_triggered_naive' THEN pn WHEN 'periodic' THEN (pf + pn) / 2 ELSE pn - 0.05 END END, NULL, 'number'
    FROM wn, (VALUES ('drift_triggered_filtered'), ('drift_triggered_naive'), ('periodic'), ('static')) a(s), (VALUES ('overall_pr_auc'), ('drift_phase_pr_auc'), ('n_refits'), ('fit_cpu_s_sum')) b(k) UNION ALL
  SELECT run, 'adaptive__delta_filtered_minus_naive', pf - pn, NULL, 'number' FROM wn UNION ALL
  SELECT run, 'demo__cum_uplift_hosr', p / 1e6, NULL, 'number' FROM wn UNION ALL SELECT run, 'demo__cum_uplift_rlf_rate', -p / 1e7, NULL, 'number' FROM wn UNION ALL
  SELECT run, 'demo__n_interventions', n % 9, NULL, 'number' FROM wn UNION ALL SELECT run, 'demo__n_retrains', n % 11, NULL, 'number' FROM wn UNION ALL
  SELECT run, 'demo__acceptance__D2', CAST(n % 2 = 0 AS INTEGER), NULL, 'bool' FROM wn UNION ALL SELECT run, 'demo__acceptance__D5', 1, NULL, 'bool' FROM wn)"""


def documents(spark, d):
    """One nested JSON document per run and pipeline."""
    c = A.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("run"))
    o = A.table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    price = lambda p: F.avg(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))) / 1e6
    st = o.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("p"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("nf"),
        price("1-URGENT").alias("pf"), price("2-HIGH").alias("pn"),
    )
    w = F.when(F.col("run") % 5 == 0, "LOF").otherwise("IsoForest")
    strat = lambda s, v: F.struct(F.lit(s).alias("strategy"), F.lit(0.1).alias("overall_pr_auc"), F.expr(v).alias("drift_phase_pr_auc"), F.lit(8).alias("cost__n_refits"))
    docs = {
        "anomaly": F.to_json(
            F.struct(
                F.when(F.col("run") % 3 == 0, w).alias("winning_detector_by_per_type_mean_pr_auc"), w.alias("winning_detector_by_mean_pr_auc"),
                F.when(F.col("run") % 2 == 0, F.lit("PCA-AE")).alias("winning_detector_by_overall_pr_auc"), (F.col("p") / 1000).alias("elapsed_s"),
            )
        ),
        "drift": F.to_json(F.struct(F.lit("ADWIN").alias("winning_detector"), F.col("nf").alias("n_detections"), F.lit(8).alias("n_drifts"))),
        "adaptive": F.to_json(F.struct(F.array(strat("drift_triggered_filtered", "pf"), strat("drift_triggered_naive", "pn"), strat("periodic", "(pf + pn) / 2"), strat("static", "pn - 0.05D")).alias("strategies"))),
        "demo": F.to_json(
            F.struct(
                F.struct((F.col("p") / 1e6).alias("hosr"), (-F.col("p") / 1e7).alias("rlf_rate")).alias("cumulative_predicted_uplift"),
                (F.col("n") % 9).alias("n_interventions"), (F.col("n") % 11).alias("n_retrains"),
                F.create_map(F.lit("D2"), F.struct((F.col("n") % 2 == 0).alias("pass")), F.lit("D5"), F.struct(F.lit(True).alias("pass"))).alias("acceptance"),
            )
        ),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("pipeline"), v.alias("doc")) for k, v in docs.items()])
    out = st.select("run", F.explode(rows).alias("_r")).select("run", "_r.*")
    return out.where(~((F.col("run") == 7) & (F.col("pipeline") == "drift")))


def ap_table(spark, d):
    c = A.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("run"))
    ap = F.array(F.struct(F.lit("LOF").alias("detector"), F.lit(0.4).alias("pr_auc")), F.struct(F.lit("IsoForest").alias("detector"), F.lit(0.3).alias("pr_auc")))
    return c.select("run", F.explode(ap).alias("_r")).select("run", "_r.*")


def metrics(spark, d):
    return materialise(S.flatten_summaries(documents(spark, d), ap_table(spark, d)), "metrics")


@query("s16_flatten_summaries", f"WITH {RUNS_SQL} SELECT CAST(run AS BIGINT) AS run, metric, round(num, 6) + 0.0 AS num, txt, kind FROM m")
def q_flatten(spark, d):
    return tidy(metrics(spark, d))


@query(
    "s15_upsert",
    "WITH o AS (SELECT o_orderkey % 500 AS seed, o_orderpriority AS tag, count(*) AS n, sum(o_custkey) AS a FROM orders GROUP BY 1, 2), n AS (SELECT l_orderkey % 700 AS seed, count(*) AS n, max(l_quantity) AS b FROM lineitem WHERE l_orderkey % 700 >= 300 GROUP BY 1) "
    "SELECT seed, tag, n, CAST(a AS BIGINT) AS a, NULL::DOUBLE AS b FROM o WHERE seed NOT IN (SELECT seed FROM n) UNION ALL SELECT seed, NULL, n, NULL, b FROM n",
)
def q_upsert(spark, d):
    old = A.table(spark, d, "orders").groupBy((F.col("o_orderkey") % 500).alias("seed"), F.col("o_orderpriority").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("a"))
    new = A.table(spark, d, "lineitem").where("l_orderkey % 700 >= 300").groupBy((F.col("l_orderkey") % 700).alias("seed")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("b"))
    return tidy(S.upsert(old, new, "seed"))


@query("s13_sinks", "SELECT o_orderpriority AS tag, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS p FROM orders GROUP BY 1")
def q_sinks(spark, d):
    t = A.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("p"))
    csv, js = fresh_path(spark, "csv"), fresh_path(spark, "json")
    S.write_csv(t.select("tag", "n"), csv)
    S.write_json_summary(t.select("tag", "p"), js)
    a = spark.read.option("header", True).schema("tag string, n long").csv(csv)
    return tidy(a.join(spark.read.schema("tag string, p double").json(js), "tag"), 4)


@query("s14_fingerprints")
def q_fingerprints(spark, d):
    files = materialise(S.fingerprint(spark, [d], [".parquet"]), "fingerprints")
    manifest = files.withColumn("sha256", F.when(F.col("path").endswith("region.parquet"), F.lit("0")).otherwise(F.col("sha256")))
    out = S.verify(manifest, files).join(files, "path")
    return out.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "size", "sha256", "status")


REPS = 5000
BOOT_SQL = f"""
nums AS (SELECT metric, num AS v FROM m WHERE kind IN ('number', 'bool') AND num IS NOT NULL AND NOT ends_with(metric, '__winning_detector') AND NOT ends_with(metric, '__missing')),
pz AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY metric) AS n FROM nums),
dr AS (SELECT metric, rep, ('0x' || substr(md5(rep || '|' || metric || '|' || pos), 1, 8))::UBIGINT % n AS pos FROM pz, range(0, {REPS}) t(rep)),
bm AS (SELECT d.metric, d.rep, avg(p.v) AS b FROM dr d JOIN pz p USING (metric, pos) GROUP BY 1, 2),
ci AS (SELECT metric, quantile_cont(b, 0.025) AS ci_lo, quantile_cont(b, 0.975) AS ci_hi FROM bm GROUP BY 1),
stab AS (SELECT n.metric, n.n, CASE WHEN n >= 2 THEN mean END AS mean, CASE WHEN n >= 2 THEN std END AS std, CASE WHEN n >= 2 THEN ci_lo END AS ci_lo, CASE WHEN n >= 2 THEN ci_hi END AS ci_hi
  FROM (SELECT metric, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS std FROM nums GROUP BY 1) n JOIN ci USING (metric)),
wc AS (SELECT CASE metric {' '.join(f"WHEN '{m}' THEN '{k}'" for k, m in V.WINNERS.items())} END AS pipeline, txt, count(*) AS n FROM m WHERE txt IS NOT NULL GROUP BY 1, 2),
win AS (SELECT pipeline, arg_max(txt, n) AS winner, CAST(sum(n) AS BIGINT) AS n_runs, max(n) / sum(n) AS modal_share FROM wc WHERE pipeline IS NOT NULL GROUP BY 1)"""


@query("x06_metric_stability", f"WITH {RUNS_SQL}, {BOOT_SQL} SELECT metric, n, {r('mean', 'std', 'ci_lo', 'ci_hi')} FROM stab")
def q_stability(spark, d):
    return tidy(V.metric_stability(metrics(spark, d), REPS))


@query("m20_bootstrap_mean", f"WITH {RUNS_SQL}, {BOOT_SQL} SELECT metric, n AS n_obs, {r('mean', 'ci_lo', 'ci_hi')} FROM stab WHERE metric LIKE 'adaptive__%'")
def q_m20(spark, d):
    from ..operators.ranking import bootstrap_statistic

    m = metrics(spark, d).where("metric LIKE 'adaptive__%' AND num IS NOT NULL")
    b = bootstrap_statistic(m, ["metric"], "num", "mean", REPS, min_rows=2)
    return tidy(b.select("metric", "n_obs", "mean", F.col("ci_low").alias("ci_lo"), F.col("ci_high").alias("ci_hi")))


@query("x07_winner_stability", f"WITH {RUNS_SQL}, {BOOT_SQL} SELECT pipeline, winner, n_runs, round(modal_share, 6) AS modal_share, modal_share >= 0.8 AS stable FROM win")
def q_winners(spark, d):
    return tidy(V.winner_stability(metrics(spark, d)))


@query(
    "x08_replication_verdicts",
    f"WITH {RUNS_SQL}, {BOOT_SQL}, v AS (SELECT 'E1' AS code, CAST(count(*) FILTER (ends_with(metric, '__missing')) AS DOUBLE) AS value, count(*) FILTER (ends_with(metric, '__missing')) = 0 AS passed FROM m UNION ALL "
    "SELECT 'E2a', modal_share, modal_share >= 0.8 FROM win WHERE pipeline = 'anomaly__per_type_mean' UNION ALL SELECT 'E2b', modal_share, modal_share >= 0.8 FROM win WHERE pipeline = 'anomaly__overall' UNION ALL "
    "SELECT 'E3', mean, mean > 0 AND ci_lo > 0 FROM stab WHERE metric = 'adaptive__delta_filtered_minus_naive' UNION ALL SELECT 'E4', mean, mean > 0 AND ci_lo > 0 FROM stab WHERE metric = 'demo__cum_uplift_hosr' UNION ALL "
    "SELECT 'E5', std / mean, std / mean < 0.3 FROM stab WHERE metric = 'drift__n_detections') SELECT code, round(value, 6) + 0.0 AS value, passed FROM v",
)
def q_verdicts(spark, d):
    m = metrics(spark, d)
    return tidy(V.replication_verdicts(m, materialise(V.metric_stability(m, REPS)), V.winner_stability(m)))


PAIR_SQL = f"""{RUNS_SQL}, ba AS (SELECT * FROM m WHERE run = 3), co AS (SELECT * FROM m WHERE run = 7),
dl AS (SELECT coalesce(ba.metric, co.metric) AS metric, ba.num AS base_num, co.num AS contrast_num, ba.txt AS bt, co.txt AS ct, CASE WHEN ba.kind = 'number' AND co.kind = 'number' THEN co.num - ba.num END AS delta FROM ba FULL JOIN co ON ba.metric = co.metric)"""


def _pair(spark, d):
    m = metrics(spark, d)
    return m.where("run = 3").drop("run"), m.where("run = 7").drop("run")


@query("x09_metric_deltas", f"WITH {PAIR_SQL} SELECT metric, {r('base_num', 'contrast_num', 'delta')}, round(CASE WHEN abs(base_num) > 1e-12 THEN delta / abs(base_num) END, 6) + 0.0 AS relative_delta FROM dl")
def q_deltas(spark, d):
    return tidy(V.metric_deltas(*_pair(spark, d)).drop("base", "contrast"))


TYPE_AP_SQL = "pt AS (SELECT CAST(c_nationkey AS VARCHAR) AS run, c_mktsegment AS detector, avg(c_acctbal) / 1e4 AS pr_auc FROM customer GROUP BY 1, 2, c_custkey % 4), mn AS (SELECT run, detector, avg(pr_auc) AS m FROM pt GROUP BY 1, 2), tp AS (SELECT run, detector, row_number() OVER (PARTITION BY run ORDER BY m DESC, detector) AS rank FROM mn QUALIFY rank <= 2)"


def per_type(spark, d):
    c = A.table(spark, d, "customer")
    return c.groupBy(F.col("c_nationkey").cast("string").alias("run"), F.col("c_mktsegment").alias("detector"), (F.col("c_custkey") % 4).alias("kind")).agg((F.avg("c_acctbal") / 1e4).alias("pr_auc"))


@query("x10_top_detectors", f"WITH {TYPE_AP_SQL} SELECT run, detector, CAST(rank AS BIGINT) AS rank FROM tp")
def q_top(spark, d):
    return tidy(V.top_detectors(per_type(spark, d)))


@query("x10_detector_overlap", f"WITH {TYPE_AP_SQL} SELECT detector FROM tp WHERE run = '3' INTERSECT SELECT detector FROM tp WHERE run = '7'")
def q_overlap(spark, d):
    return V.detector_overlap(V.top_detectors(per_type(spark, d)), "3", "7")


@query(
    "x11_portability_verdicts",
    f"WITH {PAIR_SQL}, {TYPE_AP_SQL}, o AS (SELECT count(*) AS o FROM (SELECT detector FROM tp WHERE run = '3' INTERSECT SELECT detector FROM tp WHERE run = '7')), "
    "g AS (SELECT count(*) FILTER (ends_with(metric, '__missing')) AS miss, max(base_num) FILTER (metric = 'adaptive__delta_filtered_minus_naive') AS db, max(contrast_num) FILTER (metric = 'adaptive__delta_filtered_minus_naive') AS dc, "
    "max(contrast_num) FILTER (metric = 'demo__n_interventions') AS n, max(contrast_num) FILTER (metric = 'demo__cum_uplift_hosr') AS u FROM dl) "
    "SELECT 'F1' AS code, miss = 0 AS passed FROM g UNION ALL SELECT 'F2', o > 0 FROM o UNION ALL SELECT 'F3', coalesce(db > 0 AND dc > 0, false) FROM g UNION ALL SELECT 'F4', coalesce(n >= 1, false) FROM g UNION ALL SELECT 'F5', coalesce(u > 0, false) FROM g",
)
def q_portability(spark, d):
    a, b = _pair(spark, d)
    return V.portability_verdicts(a, b, V.detector_overlap(V.top_detectors(per_type(spark, d)), "3", "7"))


@query("x12_comparison_table", f"WITH {PAIR_SQL} SELECT metric, 'base' AS timeline, (base_num IS NOT NULL OR bt IS NOT NULL) AS present FROM dl UNION ALL SELECT metric, 'contrast', (contrast_num IS NOT NULL OR ct IS NOT NULL) FROM dl")
def q_long(spark, d):
    t = V.long_table(*_pair(spark, d), "base", "contrast")
    return t.select("metric", "timeline", F.col("value").isNotNull().alias("present"))


WIDE = ["drift__n_detections", "demo__cum_uplift_hosr", "adaptive__delta_filtered_minus_naive"]


@query("x12_wide_runs", f"WITH {RUNS_SQL} SELECT CAST(run AS BIGINT) AS run, {', '.join(f'round(max(num) FILTER (metric = {chr(39)}{w}{chr(39)}), 6) AS {w}' for w in WIDE)} FROM m GROUP BY 1")
def q_wide(spark, d):
    return tidy(V.wide_runs(metrics(spark, d), WIDE))
