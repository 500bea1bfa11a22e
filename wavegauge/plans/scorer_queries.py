"""Outlier scorers, the score table and fleet-level series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fleet as FL
from ..operators import labels as L
from ..operators import ranking as M
from ..operators import scorers as S
from ..operators.windows import drop_family_sets, feature_columns
from ..functions.detectors import Adwin
from ..session import materialise
from . import adapter as A
from .calibration_queries import DRIVE_SQL, drive
from .registry import i, query, r, tidy
from .window_queries import labelled

KEY = ["ue_id", "phase_id", "window_id"]
FEATS = feature_columns()
TRAIN = "phase_id <= 3 AND label_anomaly = 0"
TRAIN_SQL = "phase_id <= 3 AND label_anomaly = 0"
UNPIVOT_SQL = f"""{A.labelled_sql()}, dbl AS (SELECT {', '.join(KEY)}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in FEATS)} FROM lab WHERE {TRAIN_SQL}),
u AS (SELECT * FROM dbl UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(FEATS)}))),
med AS (SELECT feature, quantile_cont(v, 0.5) AS m FROM u GROUP BY 1),
fil AS (SELECT u.*, coalesce(u.v, med.m, 0.0) AS f, med.m FROM u JOIN med USING (feature)),
pre AS (SELECT feature, any_value(m) AS median, avg(f) AS mean, coalesce(nullif(stddev_pop(f), 0), 1.0) AS std FROM fil GROUP BY 1)"""


def windows(spark, d):
    return materialise(labelled(spark, d), "windows")


@query("d00_preprocess", f"WITH {UNPIVOT_SQL} SELECT feature, {r('median', 'mean', 'std')} FROM pre")
def q_pre(spark, d):
    w = windows(spark, d).where(TRAIN)
    p = S.Preprocessor(FEATS).fit(w)
    # The fitted statistics are one row per feature.
    rows = [(c, m, mu, sd) for c, m, mu, sd in zip(FEATS, p.median, p.mean, p.std)]
    return tidy(spark.createDataFrame(rows, "feature string, median double, mean double, std double"))


PICK = ["rsrp_serving_dbm__p50", "sinr_serving_db__std", "n_rlf", "hosr", "rsrq_serving_db__p10"]


@query(
    "d03_gram_matrix",
    f"WITH {UNPIVOT_SQL}, z AS (SELECT f.ue_id, f.phase_id, f.window_id, f.feature, (f.f - p.mean) / CASE WHEN p.std = 0 THEN 1.0 ELSE p.std END AS z FROM fil f JOIN pre p USING (feature) "
    f"WHERE feature IN ({', '.join(repr(c) for c in PICK)})) SELECT a.feature AS a, b.feature AS b, round(sum(a.z * b.z), 4) AS g FROM z a JOIN z b USING (ue_id, phase_id, window_id) GROUP BY 1, 2",
)
def q_gram(spark, d):
    w = windows(spark, d).where(TRAIN)
    p = S.Preprocessor(PICK).fit(w)
    _, _, g = S.moments(w.select(p.vector().alias("x")), len(PICK))
    rows = [(PICK[a], PICK[b], float(g[a, b])) for a in range(len(PICK)) for b in range(len(PICK))]
    return tidy(spark.createDataFrame(rows, "a string, b string, g double"), 4)


def _scorer(cls):
    def run(spark, d):
        w = windows(spark, d)
        scored = cls(FEATS, KEY).fit(S.require_rows(w.where(TRAIN))).score(w)
        return tidy(scored.select(*KEY, "label_anomaly", "score"))

    return run


for _id, _cls in (("d01_isolation_forest", S.IsolationForestScorer), ("d02_lof_windows", S.LofScorer), ("d03_pca_residual", S.PcaScorer), ("d04_one_class", S.OneClassScorer), ("d05_autoencoder", S.AutoencoderScorer)):
    query(_id)(_scorer(_cls))


EMB_SQL = """
tr AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE label < 5), qu AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE label >= 5),
tn AS (SELECT a.id AS q, b.id AS n, list_distance(a.x, b.x) AS dist FROM tr a JOIN tr b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) <= 20),
kd AS (SELECT q AS id, max(dist) AS kdist FROM tn GROUP BY 1),
lrd AS (SELECT t.q AS id, 1.0 / (avg(greatest(k.kdist, t.dist)) + 1e-10) AS lrd FROM tn t JOIN kd k ON k.id = t.n GROUP BY 1),
qn AS (SELECT a.id AS q, b.id AS n, list_distance(a.x, b.x) AS dist FROM qu a CROSS JOIN tr b QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) <= 20)"""


def _embeddings(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    return e.where("label < 5").drop("label"), e.where("label >= 5").drop("label")


@query(
    "d02_lof_vectors",
    f"WITH {EMB_SQL} SELECT n.q AS id, round(avg(l.lrd) * (avg(greatest(k.kdist, n.dist)) + 1e-10), 6) AS score FROM qn n JOIN kd k ON k.id = n.n JOIN lrd l ON l.id = n.n GROUP BY 1",
)
def q_lof(spark, d):
    train, rest = _embeddings(spark, d)
    return tidy(S.LofScorer([], ["id"]).fit_vectors(train).score_vectors(rest))


@query(
    "d02_lof_vectors_blocked",
    f"WITH {EMB_SQL} SELECT n.q AS id, round(avg(l.lrd) * (avg(greatest(k.kdist, n.dist)) + 1e-10), 6) AS score FROM qn n JOIN kd k ON k.id = n.n JOIN lrd l ON l.id = n.n GROUP BY 1",
)
def q_lof_blocked(spark, d):
    train, rest = _embeddings(spark, d)
    return tidy(S.LofScorer([], ["id"], cap=0).fit_vectors(train).score_vectors(rest))


@query("d08_hash_sample")
def q_sample(spark, d):
    return tidy(S.hash_sample(windows(spark, d).select(*KEY, "t_mid_s"), KEY, 500))


@query("d10_score_table")
def q_score_table(spark, d):
    """All five scorers with thresholds, flags and ranking metrics."""
    w = windows(spark, d)
    s = S.score_all(w.where(TRAIN), w, FEATS, KEY).select("detector", *KEY, "label_anomaly", "score")
    s = materialise(s, "scores")
    thr = M.thresholds(s.where(TRAIN), ["detector"])
    f = M.apply_thresholds(s, thr, ["detector"])
    rates = M.flag_rates(f, ["detector"], label="label_anomaly").select("detector", "tpr", "fpr")
    return tidy(M.ranking_metrics(s, ["detector"], "score", "label_anomaly").join(rates, "detector").join(thr, "detector"))


@query("m10_family_ablation")
def q_ablation(spark, d):
    w = windows(spark, d)
    s = S.family_ablation(w, TRAIN, S.PcaScorer, KEY, drop_family_sets(), ["phase_id", "active_ids", "label_anomaly"])
    typed = L.label_per_type(materialise(s, "ablation"), A.anomaly_truth(spark), ["feature_set", "score"])
    m = M.ranking_metrics(typed, ["feature_set", "anomaly_type"]).select("feature_set", "anomaly_type", "ap")
    full = m.where("feature_set = 'full'").select("anomaly_type", F.col("ap").alias("ap_full"))
    return tidy(m.join(full, "anomaly_type").withColumn("delta_ap", F.col("ap") - F.col("ap_full")))


# --- fleet series ------------------------------------------------------------------------------

BUCKET, HOURS = 3600.0, 6 * 3600.0
FLEET_SQL = f"""{DRIVE_SQL}, seg AS (SELECT * FROM drive WHERE operator_id IS NOT NULL),
b0 AS (SELECT operator_id, ran_type, min(time_s) AS t0, CAST(ceil((max(time_s) - min(time_s) + 1e-9) / {BUCKET}) AS BIGINT) AS n FROM seg GROUP BY ALL),
ag AS (SELECT operator_id, ran_type, CAST(least(floor((time_s - t0) / {BUCKET}), n - 1) AS BIGINT) AS i, avg(rsrp_serving_dbm) AS rsrp_mean, avg(sinr_serving_db) AS sinr_mean,
  count(DISTINCT serving_cell_id) AS n_cells, count(*) AS n_samples FROM seg JOIN b0 USING (operator_id, ran_type) GROUP BY 1, 2, 3),
lg AS (SELECT *, lag(serving_cell_id) OVER w AS src, lag(time_s) OVER w AS pt FROM seg WINDOW w AS (PARTITION BY operator_id, ran_type ORDER BY time_s, event_id)),
mv AS (SELECT operator_id, ran_type, CAST(least(floor((time_s - t0) / {BUCKET}), n - 1) AS BIGINT) AS j, count(*) AS c FROM lg JOIN b0 USING (operator_id, ran_type)
  WHERE serving_cell_id <> src AND time_s - pt < {BUCKET} GROUP BY 1, 2, 3),
mw AS (SELECT operator_id, ran_type, j + o AS i, sum(c) AS c FROM mv, (SELECT unnest([-2, -1, 0, 1, 2, 3]) AS o) GROUP BY 1, 2, 3),
gr AS (SELECT operator_id, ran_type, CAST(kk AS BIGINT) AS i, kk * {BUCKET} AS t_s, CAST(floor((t0 + kk * {BUCKET}) / 3600) AS BIGINT) % 24 AS hour FROM (SELECT *, unnest(range(n)) AS kk FROM b0)),
fl AS (SELECT g.operator_id, g.ran_type, g.i, g.t_s, g.hour, rsrp_mean, sinr_mean, coalesce(n_cells, 0) AS n_cells, coalesce(n_samples, 0) AS n_samples,
  coalesce(mw.c, 0) / {HOURS} AS ho_rate FROM gr g LEFT JOIN ag USING (operator_id, ran_type, i) LEFT JOIN mw USING (operator_id, ran_type, i))"""
SEGMENT = ["operator_id", "ran_type"]


def fleet(spark, d):
    return FL.fleet_streams(drive(spark, d), BUCKET, HOURS, max_gap=BUCKET, tie="event_id", keys=SEGMENT)


@query("x01_fleet_streams", f"WITH {FLEET_SQL} SELECT {i('operator_id')}, ran_type, i, hour, {r('t_s', 'rsrp_mean', 'sinr_mean')}, round(ho_rate, 9) AS ho_rate, n_cells, n_samples FROM fl")
def q_fleet(spark, d):
    f = fleet(spark, d)
    return tidy(f, 9).withColumns({c: F.round(c, 6) for c in ("t_s", "rsrp_mean", "sinr_mean")})


@query(
    "d09_fleet_windows",
    f"WITH {FLEET_SQL}, w AS (SELECT operator_id, ran_type, unnest(range(greatest(n - 12, 0) // 2 + 1)) AS k FROM b0) SELECT {i('w.operator_id').replace('AS w.', 'AS ')}, w.ran_type, k, round(k * 2 * {BUCKET} + {BUCKET * 6}, 6) AS t_center_s, "
    + ", ".join(f"round(coalesce(avg({c}), 0.0), 8) AS {c}__mean, round(coalesce(stddev_pop({c}), 0.0), 8) AS {c}__std" for c in FL.FLEET)
    + " FROM w JOIN fl ON fl.operator_id = w.operator_id AND fl.ran_type = w.ran_type AND fl.i >= k * 2 AND fl.i < k * 2 + 12 GROUP BY ALL",
)
def q_fleet_windows(spark, d):
    return tidy(FL.fleet_windows(materialise(fleet(spark, d), "fleet"), BUCKET, 12 * BUCKET, 2 * BUCKET, SEGMENT), 8)


def _anomalies(spark, d):
    f = materialise(fleet(spark, d), "fleet")
    w = materialise(FL.fleet_windows(f, BUCKET, 12 * BUCKET, 2 * BUCKET, SEGMENT), "fleet-windows")
    return f, materialise(FL.fleet_anomalies(w, train_s=7 * 86400.0, keys=SEGMENT), "fleet-scores")


@query("d09_fleet_anomalies")
def q_fleet_anomalies(spark, d):
    return tidy(_anomalies(spark, d)[1].select(*SEGMENT, "k", "t_center_s", "score", "threshold", "is_train", "flag"))


@query("x04_hourly_flags")
def q_hourly(spark, d):
    f, a = _anomalies(spark, d)
    return tidy(FL.hourly_counts(a.where("flag = 1"), f, BUCKET, keys=SEGMENT))


HSQL = f"""WITH {FLEET_SQL}, q AS (SELECT operator_id, ran_type, quantile_cont(n_samples, 0.9) AS t FROM fl GROUP BY 1, 2),
c AS (SELECT operator_id, ran_type, hour, count(*) AS n FROM fl JOIN q USING (operator_id, ran_type) WHERE n_samples > t GROUP BY 1, 2, 3)
SELECT {i('operator_id')}, ran_type, CAST(hour AS BIGINT) AS hour, coalesce(c.n, 0) AS n FROM (SELECT operator_id, ran_type, unnest(range(24)) AS hour FROM b0) LEFT JOIN c USING (operator_id, ran_type, hour)"""


@query("x03_busy_hours", HSQL)
def q_busy(spark, d):
    from ..operators.scale import grouped_quantiles

    f = materialise(fleet(spark, d), "fleet")
    t = grouped_quantiles(f, SEGMENT, {"n_samples": {"t": 0.9}})
    busy = f.join(t, SEGMENT).where(F.col("n_samples") > F.col("t")).select(*SEGMENT, F.col("t_s").alias("t_center_s"))
    return tidy(FL.hourly_counts(busy, f, BUCKET, keys=SEGMENT))


@query("x04_plausibility")
def q_plausible(spark, d):
    f, a = _anomalies(spark, d)
    note = "Note: no ground-truth labels available for this feed."
    return tidy(FL.plausibility(a, FL.hourly_counts(a.where("flag = 1"), f, BUCKET, keys=SEGMENT), note, keys=SEGMENT))


@query("x05_change_points")
def q_changes(spark, d):
    f = fleet(spark, d).withColumn("ho_rate", F.col("ho_rate") * 3600.0)  # moves per hour
    return tidy(FL.change_points(materialise(f, "fleet"), lambda: Adwin(delta=0.002), ["rsrp_mean", "sinr_mean", "ho_rate"], SEGMENT))
