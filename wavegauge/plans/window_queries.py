"""Window features, labels and ranking metrics over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import id_list
from ..operators import labels as L
from ..operators import ranking as M
from ..operators.resampling import MIX_A, MIX_B, STEP
from ..operators.scale import grouped_quantiles
from ..operators.windows import DERIVED, SAMPLE_COLUMNS, count_columns, drop_family_sets, window_features
from ..session import materialise
from . import adapter as A
from .registry import i, query, r, tidy

W, S = 6.0, 1.0
MEASURED = [f"{c}__{s}" for c in SAMPLE_COLUMNS for s in ("p10", "p50", "p90", "std")]


def features(spark, d, sizes=None):
    t = A.telemetry(spark, d)
    return window_features(t, t, W, S, sizes=sizes)


def labelled(spark, d, sizes=None):
    return L.label_windows(features(spark, d, sizes), A.anomaly_truth(spark))


KEYS = "ue_id, phase_id, window_id"


@query(
    "f01_window_features",
    f"WITH {A.features_sql()} SELECT {i('ue_id', 'phase_id', 'window_id', 'serving_cell_mode', *count_columns())}, scenario_name, "
    f"{r('t_start_s', 't_end_s', 't_mid_s', *MEASURED, *DERIVED)} FROM feat",
)
def q_features(spark, d):
    return tidy(features(spark, d).drop("window_s"))


@query(
    "f01_window_index",
    f"WITH {A.windows_sql()} SELECT {i('w.ue_id', 'w.phase_id').replace('AS w.', 'AS ')}, count(DISTINCT w.window_id) AS n_windows, "
    "CAST(max(w.window_id) AS BIGINT) AS last_window FROM win w JOIN samples s ON s.ue_id = w.ue_id AND s.phase_id = w.phase_id "
    "AND s.time_s >= w.t_start_s AND s.time_s < w.t_end_s GROUP BY 1, 2",
)
def q_window_index(spark, d):
    f = features(spark, d)
    return tidy(f.groupBy("ue_id", "phase_id").agg(F.count("window_id").alias("n_windows"), F.max("window_id").alias("last_window")))


SIZES = ((2.0, 1.0), (6.0, 1.0), (12.0, 1.0))


@query(
    "m09_window_sweep",
    f"WITH {A.labelled_sql(SIZES)} SELECT round(window_s, 6) AS window_s, {i('phase_id')}, count(*) AS n_windows, "
    "CAST(sum(label_anomaly) AS BIGINT) AS n_pos, round(avg(rsrp_serving_dbm__p50), 6) AS mean_rsrp_p50, "
    "round(avg(hosr), 6) AS mean_hosr FROM lab GROUP BY 1, 2",
)
def q_sweep(spark, d):
    f = labelled(spark, d, sizes=[tuple(s) for s in SIZES])
    return tidy(
        f.groupBy("window_s", "phase_id").agg(
            F.count(F.lit(1)).alias("n_windows"),
            F.sum("label_anomaly").alias("n_pos"),
            F.avg("rsrp_serving_dbm__p50").alias("mean_rsrp_p50"),
            F.avg("hosr").alias("mean_hosr"),
        )
    )


@query(
    "l02_window_labels",
    f"WITH {A.labelled_sql()} SELECT {i('ue_id', 'phase_id', 'window_id', 'label_anomaly')}, "
    "array_to_string(ids, ',') AS active_anomaly_id FROM lab",
)
def q_labels(spark, d):
    return tidy(labelled(spark, d).select("ue_id", "phase_id", "window_id", "label_anomaly", "active_anomaly_id"))


@query(
    "l01_scope_parse",
    f"WITH {A.SAMPLES_SQL}, {A.TRUTH_SQL} SELECT t.anomaly_id, CAST(coalesce(len(a_ues), -1) AS BIGINT) AS n_ues, "
    "CAST(coalesce(len(a_cells), -1) AS BIGINT) AS n_cells, count(*) AS n_samples FROM truth t JOIN samples s "
    "ON s.time_s >= t.a_start AND s.time_s < t.a_end AND (a_ues IS NULL OR list_contains(a_ues, CAST(ue_id AS INTEGER))) "
    "AND (a_cells IS NULL OR list_contains(a_cells, serving_cell_id)) GROUP BY 1, 2, 3",
)
def q_scope(spark, d):
    from ..operators.joins import interval_join

    t = L.parse_truth(A.anomaly_truth(spark))
    s = A.telemetry(spark, d).select("time_s", "ue_id", "serving_cell_id")
    hit = interval_join(s, t, "time_s", "a_start", "a_end")
    ok = L._in_scope(F.col("a_ues"), F.col("ue_id").cast("int")) & L._in_scope(F.col("a_cells"), F.col("serving_cell_id"))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(-1))
    return tidy(
        hit.where(ok)
        .groupBy("anomaly_id", size("a_ues").alias("n_ues"), size("a_cells").alias("n_cells"))
        .agg(F.count(F.lit(1)).alias("n_samples"))
    )


@query(
    "l03_labels_per_id",
    f"WITH {A.labelled_sql()} SELECT {i('ue_id', 'phase_id', 'window_id')}, t.anomaly_id, "
    "CAST(list_contains(ids, t.anomaly_id) AS BIGINT) AS label FROM lab, (SELECT DISTINCT anomaly_id FROM truth) t".replace(
        "CAST(phase_id", "CAST(lab.phase_id"
    ),
)
def q_labels_per_id(spark, d):
    return tidy(L.label_per_id(labelled(spark, d), A.anomaly_truth(spark), ["ue_id", "phase_id", "window_id"]))


@query(
    "l03_labels_wide",
    f"WITH {A.labelled_sql()} SELECT {i('phase_id')}, "
    + ", ".join(f"CAST(sum(CAST(list_contains(ids, '{row[0]}') AS INTEGER)) AS BIGINT) AS \"label_{row[0]}\"" for row in A.ANOMALY_ROWS)
    + " FROM lab GROUP BY 1",
)
def q_labels_wide(spark, d):
    ids = [row[0] for row in A.ANOMALY_ROWS]
    long = L.label_per_id(labelled(spark, d), A.anomaly_truth(spark), ["phase_id"])
    wide = long.groupBy("phase_id").pivot("anomaly_id", ids).agg(F.sum("label"))
    return tidy(wide.select("phase_id", *[F.col(f"`{a}`").alias(f"label_{a}") for a in ids]))


@query(
    "l06_drift_phases",
    f"WITH {A.features_sql()}, {A.DRIFT_SQL} SELECT DISTINCT CAST(f.phase_id AS BIGINT) AS phase_id FROM feat f "
    "JOIN drift d ON f.t_mid_s >= d.start_time_s AND f.t_mid_s < d.end_time_s",
)
def q_drift_phases(spark, d):
    return tidy(L.drift_phases(features(spark, d), A.drift_truth(spark)))


TYPE_SQL = """
types AS (SELECT anomaly_type, list(anomaly_id) AS tids, list(DISTINCT phase_id) AS phases FROM truth GROUP BY 1),
typed AS (SELECT l.*, t.anomaly_type, CAST(list_has_any(l.ids, t.tids) AS INTEGER) AS label
  FROM lab l JOIN types t ON list_contains(t.phases, l.phase_id))"""


@query(
    "l07_labels_per_type",
    f"WITH {A.labelled_sql()}, {TYPE_SQL} SELECT anomaly_type, {i('phase_id')}, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos "
    "FROM typed GROUP BY 1, 2",
)
def q_labels_per_type(spark, d):
    t = L.label_per_type(labelled(spark, d), A.anomaly_truth(spark), ["phase_id"])
    return tidy(t.groupBy("anomaly_type", "phase_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos")))


# --- ranking metrics: two hand-made scores over the window table -------------------------------

DETECTORS = {"load": "n_ho_fail + 0.5 * n_rlf", "signal": "-coalesce(sinr_serving_db__p10, 0.0)", "jitter": "rsrq_serving_db__std"}
SCORED_SQL = """
scored AS (""" + " UNION ALL ".join(
    f"SELECT *, '{n}' AS detector, CAST(round({e}, 9) AS DOUBLE) AS score FROM lab" for n, e in DETECTORS.items()
) + ")"


def scored(spark, d):
    """Long score table of three simple detectors; scores have many ties."""
    base = labelled(spark, d)
    stack = F.array(*[F.struct(F.lit(n).alias("detector"), F.round(F.expr(e).cast("double"), 9).alias("score")) for n, e in DETECTORS.items()])
    base = base.select("phase_id", "scenario_name", "t_mid_s", "t_end_s", "active_ids", "label_anomaly", stack.alias("_d"))
    base = materialise(base, "scored")  # metrics read the scores several times
    return base.withColumn("_d", F.explode("_d")).withColumns({"detector": F.col("_d.detector"), "score": F.col("_d.score")}).drop("_d")


def ap_sql(src: str, keys: str, label: str, score: str = "score") -> str:
    """CTE ``ap``: average precision and ROC-AUC by window functions over distinct scores."""
    part = f"PARTITION BY {keys} " if keys else ""
    grp = f"{keys}, " if keys else ""
    group_by = f"GROUP BY {keys}" if keys else ""
    return f"""
steps AS (SELECT {grp}{score} AS sc, sum({label}) AS p, count(*) AS n FROM {src} WHERE {score} IS NOT NULL GROUP BY {grp}{score}),
cum AS (SELECT *, sum(p) OVER ({part}ORDER BY sc DESC) AS cp, sum(n) OVER ({part}ORDER BY sc DESC) AS cn FROM steps),
ap AS (SELECT {grp}sum(p) AS n_pos, sum(n - p) AS n_neg,
  CASE WHEN sum(p) > 0 AND sum(n - p) > 0 THEN sum(p * (cp / cn)) / sum(p) END AS ap,
  CASE WHEN sum(p) > 0 AND sum(n - p) > 0 THEN sum((n - p) * (cp - p / 2)) / (sum(p) * sum(n - p)) END AS roc_auc
  FROM cum {group_by})"""


@query(
    "m01_average_precision",
    f"WITH {A.labelled_sql()}, {SCORED_SQL}, {ap_sql('scored', 'detector', 'label_anomaly')} "
    f"SELECT detector, {r('ap', 'roc_auc')}, {i('n_pos', 'n_neg')} FROM ap",
)
def q_ap(spark, d):
    return tidy(M.ranking_metrics(scored(spark, d), ["detector"], "score", "label_anomaly"))


DOC_SQL = "docs AS (SELECT lang, n_chars AS score, 1 - quality AS label FROM labels JOIN documents USING (doc_id))"


@query(
    "m02_roc_auc",
    f"WITH {DOC_SQL}, {ap_sql('docs', 'lang', 'label')} SELECT lang, {r('ap', 'roc_auc')}, {i('n_pos', 'n_neg')} FROM ap",
)
def q_roc(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("score"))
    y = A.table(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    return tidy(M.ranking_metrics(docs.join(y, "doc_id"), ["lang"], "score", "label"))


BOOT = 1000


def mix_sql(name: str, expr: str) -> str:
    """Columns that mix a 32-bit number as ``resampling.mix32`` does; the last one is called ``name``."""
    u = "::UBIGINT"
    low = f"4294967295{u}"
    return (
        f"({expr}){u} AS {name}0, (xor({name}0, {name}0 >> 16) * {MIX_A}{u}) & {low} AS {name}1, "
        f"(xor({name}1, {name}1 >> 15) * {MIX_B}{u}) & {low} AS {name}2, xor({name}2, {name}2 >> 16) AS {name}"
    )


def draw_sql(stratum: str, number: str) -> str:
    """Column ``h``: draw ``number`` of replicate ``rep`` in a stratum, all rows in block 0."""
    step = f"(e + ({number})::UBIGINT * {STEP}::UBIGINT) & 4294967295::UBIGINT"
    return f"{mix_sql('c', f'rep * 4 + {stratum} + 1')}, {mix_sql('e', 'c')}, {mix_sql('h', step)}"


def boot_sql(src: str, keys: list[str], label: str, stratify: bool, reps: int = BOOT, alpha: float = 0.05) -> str:
    k = "".join(f"{c}, " for c in keys)
    on = " AND ".join([f"d.{c} = p.{c}" for c in keys] + ["d.y = p.y", "d.pos = p.pos"])
    takes = f"""
bsizes AS (SELECT {k}sum(y) AS np, count(*) AS nr FROM posn {('GROUP BY ' + ', '.join(keys)) if keys else ''}),
takes AS (SELECT {k}rep, np, nr - np AS nn, np AS t1, nr - np AS t0 FROM bsizes, range(0, {reps}) t(rep)),"""
    if not stratify:
        takes = takes.replace("takes AS (SELECT", "pairs AS (SELECT").replace("np, nr - np AS nn, np AS t1, nr - np AS t0", "np, nr, unnest(range(nr)) AS j") + f"""
marks AS (SELECT {k}rep, np, nr, h < np / nr * 4294967296.0 AS hit FROM (SELECT *, {draw_sql('2', 'j')} FROM pairs)),
takes AS (SELECT {k}rep, any_value(np) AS np, any_value(nr - np) AS nn, count(*) FILTER (hit) AS t1, count(*) FILTER (NOT hit) AS t0 FROM marks GROUP BY {k}rep),"""
    return f"""
posn AS (SELECT {k}CAST({label} AS INTEGER) AS y, score AS sc,
  row_number() OVER (PARTITION BY {k}{label} ORDER BY score) - 1 AS pos FROM {src} WHERE score IS NOT NULL),{takes}
turns AS (SELECT {k}rep, 1 AS y, np AS m, unnest(range(t1::BIGINT)) AS j FROM takes UNION ALL SELECT {k}rep, 0, nn, unnest(range(t0::BIGINT)) FROM takes),
draws AS (SELECT {k}rep, y, CAST((h * m::UBIGINT) >> 32 AS BIGINT) AS pos FROM (SELECT *, {draw_sql('y', 'j')} FROM turns)),
picked AS (SELECT {''.join(f'd.{c}, ' for c in keys)}d.rep, p.y AS label, p.sc AS score FROM draws d JOIN posn p ON {on}),
bsteps AS (SELECT {k}rep, score, sum(label) AS p, count(*) AS n FROM picked GROUP BY ALL),
bcum AS (SELECT *, sum(p) OVER (PARTITION BY {k}rep ORDER BY score DESC) AS cp, sum(n) OVER (PARTITION BY {k}rep ORDER BY score DESC) AS cn FROM bsteps),
brep AS (SELECT {k}rep, CASE WHEN sum(p) > 0 AND sum(n - p) > 0 THEN sum(p * (cp / cn)) / sum(p) END AS bap FROM bcum GROUP BY {k}rep),
ci AS (SELECT {k}quantile_cont(bap, {alpha / 2}) AS ci_low, quantile_cont(bap, {1 - alpha / 2}) AS ci_high, count(bap) AS n_valid
  FROM brep WHERE bap IS NOT NULL {('GROUP BY ' + ', '.join(keys)) if keys else ''})"""


@query(
    "m03_bootstrap_ap",
    f"WITH {A.labelled_sql()}, {SCORED_SQL}, {ap_sql('scored', 'detector', 'label_anomaly')}, "
    f"{boot_sql('scored', ['detector'], 'label_anomaly', True)} "
    f"SELECT detector, {r('ap', 'ci_low', 'ci_high')}, {i('n_pos', 'n_neg', 'n_valid')} FROM ap JOIN ci USING (detector)",
)
def q_bootstrap(spark, d):
    s = scored(spark, d).select("detector", "score", "label_anomaly")
    return tidy(M.bootstrap_ap(s, ["detector"], label="label_anomaly", reps=BOOT))


@query(
    "m03_bootstrap_ap_plain",
    f"WITH {DOC_SQL}, {ap_sql('docs', '', 'label')}, {boot_sql('docs', [], 'label', False)} "
    f"SELECT {r('ap', 'ci_low', 'ci_high')}, {i('n_pos', 'n_neg', 'n_valid')} FROM ap, ci",
)
def q_bootstrap_plain(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score"))
    y = A.table(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    return tidy(M.bootstrap_ap(docs.join(y, "doc_id").drop("doc_id"), [], reps=BOOT, stratify=False))


# --- thresholds and flags ----------------------------------------------------------------------

TRAIN = "phase_id <= 3 AND label_anomaly = 0"
FLAG_SQL = f"""
thr AS (SELECT detector, quantile_cont(score, 0.95) AS threshold FROM scored WHERE {TRAIN} GROUP BY 1),
flagged AS (SELECT s.*, t.threshold, CAST(s.score >= t.threshold AS INTEGER) AS flag FROM scored s JOIN thr t USING (detector))"""
SCORED = f"WITH {A.labelled_sql()}, {SCORED_SQL}, {FLAG_SQL}"


def flagged(spark, d):
    s = scored(spark, d)
    thr = M.thresholds(s.where(TRAIN), ["detector"])
    return M.apply_thresholds(s, thr, ["detector"])


@query("d06_thresholds", f"{SCORED} SELECT detector, {r('threshold')}, count(*) AS n, CAST(sum(flag) AS BIGINT) AS n_flag FROM flagged GROUP BY detector, threshold")
def q_thresholds(spark, d):
    return tidy(flagged(spark, d).groupBy("detector", "threshold").agg(F.count(F.lit(1)).alias("n"), F.sum("flag").alias("n_flag")))


@query("d07_training_pool", f"WITH {A.labelled_sql()} SELECT {i('phase_id')}, count(*) AS n, {r('max(t_end_s)').replace('AS max(t_end_s)', 'AS last_end')} FROM lab WHERE {TRAIN} AND t_end_s <= 60.0 GROUP BY 1")
def q_pool(spark, d):
    from ..operators.scorers import training_pool

    p = training_pool(labelled(spark, d), max_phase=3, max_end=60.0)
    return tidy(p.groupBy("phase_id").agg(F.count(F.lit(1)).alias("n"), F.max("t_end_s").alias("last_end")))


@query(
    "m04_phase_rates",
    f"{SCORED} SELECT detector, {i('phase_id')}, round(avg(flag) FILTER (label_anomaly = 1), 6) AS tpr, round(avg(flag) FILTER (label_anomaly = 0), 6) AS fpr, "
    "count(*) AS n, count(*) FILTER (label_anomaly = 1) AS n_pos, count(*) FILTER (label_anomaly = 0) AS n_neg FROM flagged GROUP BY 1, 2",
)
def q_phase_rates(spark, d):
    return tidy(M.flag_rates(flagged(spark, d), ["detector", "phase_id"], label="label_anomaly"))


@query(
    "m05_per_anomaly",
    f"{SCORED}, one AS (SELECT f.detector, t.anomaly_id, f.score, f.flag, CAST(list_contains(f.ids, t.anomaly_id) AS INTEGER) AS label FROM flagged f JOIN truth t ON f.phase_id = t.phase_id), "
    f"{ap_sql('one', 'detector, anomaly_id', 'label')}, fr AS (SELECT detector, anomaly_id, avg(flag) FILTER (label = 1) AS tpr, avg(flag) FILTER (label = 0) AS fpr FROM one GROUP BY 1, 2) "
    f"SELECT detector, anomaly_id, {r('ap', 'roc_auc', 'tpr', 'fpr')}, {i('n_pos', 'n_neg')} FROM ap JOIN fr USING (detector, anomaly_id)",
)
def q_per_anomaly(spark, d):
    f = flagged(spark, d)
    t = A.anomaly_truth(spark).select("anomaly_id", "phase_id")
    packed = t.groupBy("phase_id").agg(F.collect_set("anomaly_id").alias("_ids"))
    one = f.join(packed, "phase_id").withColumn("anomaly_id", F.explode("_ids"))
    one = one.withColumn("label", F.array_contains("active_ids", F.col("anomaly_id")).cast("int"))
    keys = ["detector", "anomaly_id"]
    return tidy(M.ranking_metrics(one, keys).join(M.flag_rates(one, keys).select(*keys, "tpr", "fpr"), keys))


@query(
    "m06_per_type",
    f"{SCORED}, {TYPE_SQL.replace('FROM lab l', 'FROM flagged l')}, {ap_sql('typed', 'detector, anomaly_type', 'label')}, "
    f"{boot_sql('typed', ['detector', 'anomaly_type'], 'label', True)}, "
    "fr AS (SELECT detector, anomaly_type, avg(flag) FILTER (label = 1) AS tpr, avg(flag) FILTER (label = 0) AS fpr FROM typed GROUP BY 1, 2) "
    f"SELECT detector, anomaly_type, {r('ap', 'roc_auc', 'ci_low', 'ci_high', 'tpr', 'fpr')}, {i('n_pos', 'n_neg', 'n_valid')} "
    "FROM ap LEFT JOIN ci USING (detector, anomaly_type) JOIN fr USING (detector, anomaly_type)",
)
def q_per_type(spark, d):
    typed = L.label_per_type(flagged(spark, d), A.anomaly_truth(spark), ["detector", "score", "flag"])
    keys = ["detector", "anomaly_type"]
    m = M.ranking_metrics(typed, keys).join(M.flag_rates(typed, keys).select(*keys, "tpr", "fpr"), keys)
    return tidy(m.join(M.bootstrap_ap(typed, keys, reps=BOOT).select(*keys, "ci_low", "ci_high", "n_valid"), keys))


@query(
    "m07_overall",
    f"{SCORED}, {ap_sql('flagged', 'detector', 'label_anomaly')}, {boot_sql('flagged', ['detector'], 'label_anomaly', True)}, fr AS (SELECT detector, avg(flag) FILTER (label_anomaly = 1) AS tpr, "
    f"avg(flag) FILTER (label_anomaly = 0) AS fpr FROM flagged GROUP BY 1) SELECT detector, {r('ap', 'roc_auc', 'ci_low', 'ci_high', 'tpr', 'fpr')}, {i('n_pos', 'n_neg', 'n_valid')} FROM ap JOIN fr USING (detector) LEFT JOIN ci USING (detector)",
)
def q_overall(spark, d):
    f = flagged(spark, d)
    rates = M.flag_rates(f, ["detector"], label="label_anomaly").select("detector", "tpr", "fpr")
    ci = M.bootstrap_ap(f, ["detector"], label="label_anomaly", reps=BOOT).select("detector", "ci_low", "ci_high", "n_valid")
    return tidy(M.ranking_metrics(f, ["detector"], "score", "label_anomaly").join(rates, "detector").join(ci, "detector"))


@query(
    "m08_format_interval",
    f"WITH {DOC_SQL} SELECT lang, CASE WHEN quantile_cont(score, 0.5) IS NULL THEN 'nan' ELSE printf('%.3f [%.3f, %.3f]', quantile_cont(score, 0.5), quantile_cont(score, 0.25), quantile_cont(score, 0.75)) END AS text FROM docs GROUP BY 1",
)
def q_format(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    j = docs.join(A.table(spark, d, "labels").select("doc_id"), "doc_id")
    q = grouped_quantiles(j, ["lang"], {"score": {"a": 0.25, "b": 0.5, "c": 0.75}})
    return q.select("lang", M.format_interval(F.col("b"), F.col("a"), F.col("c")).alias("text"))


@query(
    "m11_winners",
    f"{SCORED}, {TYPE_SQL.replace('FROM lab l', 'FROM flagged l')}, {ap_sql('typed', 'detector, anomaly_type', 'label')}, "
    "mean_ap AS (SELECT detector, avg(ap) AS v FROM ap GROUP BY 1), "
    f"{ap_sql('flagged', 'detector', 'label_anomaly').replace('steps AS', 'steps2 AS').replace('FROM steps', 'FROM steps2').replace('cum AS', 'cum2 AS').replace('FROM cum ', 'FROM cum2 ').replace('ap AS (SELECT', 'pooled AS (SELECT')} "
    "SELECT 'per_type' AS scope, arg_max(detector, v) AS winner, round(max(v), 6) AS ap FROM mean_ap "
    "UNION ALL SELECT 'pooled', arg_max(detector, ap), round(max(ap), 6) FROM pooled",
)
def q_winners(spark, d):
    f = flagged(spark, d)
    per = M.ranking_metrics(L.label_per_type(f, A.anomaly_truth(spark), ["detector", "score"]), ["detector", "anomaly_type"])
    per = per.groupBy("detector").agg(F.avg("ap").alias("ap"))
    pooled = M.ranking_metrics(f, ["detector"], "score", "label_anomaly").select("detector", "ap")
    pick = [F.max_by("detector", "ap").alias("winner"), F.max("ap").alias("ap")]
    out = per.agg(F.lit("per_type").alias("scope"), *pick).unionByName(pooled.agg(F.lit("pooled").alias("scope"), *pick))
    return tidy(out)


@query(
    "m12_smoke_acceptance",
    f"{SCORED}, one AS (SELECT f.detector, t.anomaly_id, f.score, CAST(list_contains(f.ids, t.anomaly_id) AS INTEGER) AS label FROM flagged f JOIN truth t ON f.phase_id = t.phase_id), "
    f"{ap_sql('one', 'detector, anomaly_id', 'label')}, best AS (SELECT anomaly_id, max(ap) AS ap FROM ap GROUP BY 1), "
    "ph AS (SELECT detector, phase_id, scenario_name <> 'baseline' AS drifted, avg(flag) FILTER (label_anomaly = 0) AS fpr FROM flagged GROUP BY ALL), "
    "rt AS (SELECT detector, avg(fpr) FILTER (drifted) / nullif(avg(fpr) FILTER (NOT drifted), 0) AS ratio FROM ph GROUP BY 1) "
    "SELECT (SELECT count(*) FROM best WHERE ap > 0.1) AS n_ids_found, (SELECT count(*) >= 2 FROM best WHERE ap > 0.1) AS ids_pass, "
    "(SELECT round(max(ratio), 6) FROM rt) AS max_fpr_ratio, (SELECT coalesce(max(ratio) > 2, false) FROM rt) AS ratio_pass",
)
def q_smoke(spark, d):
    f = flagged(spark, d)
    t = A.anomaly_truth(spark).groupBy("phase_id").agg(F.collect_set("anomaly_id").alias("_ids"))
    one = f.join(t, "phase_id").withColumn("anomaly_id", F.explode("_ids"))
    one = one.withColumn("label", F.array_contains("active_ids", F.col("anomaly_id")).cast("int"))
    best = M.ranking_metrics(one, ["detector", "anomaly_id"]).groupBy("anomaly_id").agg(F.max("ap").alias("ap"))
    found = best.agg(F.count(F.when(F.col("ap") > 0.1, 1)).alias("n_ids_found"))
    ph = M.flag_rates(f.withColumn("drifted", F.col("scenario_name") != "baseline"), ["detector", "phase_id", "drifted"], label="label_anomaly")
    rt = ph.groupBy("detector").agg(F.avg(F.when(F.col("drifted"), F.col("fpr"))).alias("a"), F.avg(F.when(~F.col("drifted"), F.col("fpr"))).alias("b"))
    rt = rt.agg(F.max(F.when(F.col("b") != 0, F.col("a") / F.col("b"))).alias("max_fpr_ratio"))
    out = found.crossJoin(F.broadcast(rt))  # one row each
    return tidy(
        out.withColumns({"ids_pass": F.col("n_ids_found") >= 2, "ratio_pass": F.coalesce(F.col("max_fpr_ratio") > 2, F.lit(False))})
    )


CENTRES = """
span AS (SELECT detector, min(t_mid_s) AS lo, max(t_mid_s) AS hi FROM scored WHERE score IS NOT NULL GROUP BY 1),
cent AS (SELECT detector, lo + 24.0 + kk * 12.0 AS c FROM span, range(0, 200) t(kk) WHERE lo + 24.0 + kk * 12.0 < hi - 24.0 + 1e-9),
inwin AS (SELECT c.detector, c.c AS t_center_s, s.score, s.label_anomaly AS label FROM cent c JOIN scored s ON s.detector = c.detector
  AND s.t_mid_s >= c.c - 24.0 AND s.t_mid_s <= c.c + 24.0 AND s.score IS NOT NULL)"""


@query(
    "m13_sliding_ap",
    f"WITH {A.labelled_sql()}, {SCORED_SQL}, {CENTRES}, {ap_sql('inwin', 'detector, t_center_s', 'label')} "
    "SELECT c.detector, round(c.c, 6) AS t_center_s, round(CASE WHEN n_pos >= 2 AND n_neg >= 5 THEN ap END, 6) AS pr_auc, "
    "CAST(coalesce(n_pos, 0) AS BIGINT) AS n_pos, CAST(coalesce(n_neg, 0) AS BIGINT) AS n_neg FROM cent c LEFT JOIN ap a ON a.detector = c.detector AND a.t_center_s = c.c",
)
def q_sliding(spark, d):
    return tidy(M.sliding_ap(scored(spark, d), ["detector"], window=48.0, stride=12.0))


@query(
    "m14_drift_phase_ap",
    f"WITH {A.labelled_sql()}, {SCORED_SQL}, {A.DRIFT_SQL}, dph AS (SELECT DISTINCT f.phase_id FROM feat f JOIN drift d ON f.t_mid_s >= d.start_time_s AND f.t_mid_s < d.end_time_s), "
    "ind AS (SELECT * FROM scored WHERE phase_id IN (SELECT phase_id FROM dph) OR phase_id IN (4, 9)), "
    f"{ap_sql('ind', 'detector', 'label_anomaly')} SELECT detector, {r('ap', 'roc_auc')}, {i('n_pos', 'n_neg')} FROM ap",
)
def q_drift_phase_ap(spark, d):
    s = scored(spark, d)
    phases = L.drift_phases(s, A.drift_truth(spark)).unionByName(spark.createDataFrame([(4,), (9,)], "phase_id int")).distinct()
    return tidy(M.ranking_metrics(s.join(phases, "phase_id", "left_semi"), ["detector"], "score", "label_anomaly"))
