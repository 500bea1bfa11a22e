"""Fleet streams, drift detectors and firing-log metrics over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import labels as L
from ..operators import streams as S
from ..session import materialise
from . import adapter as A
from .registry import i, query, r, tidy

WIN = 6.0
STREAM_SQL = f"""{A.SAMPLES_SQL},
gb AS (SELECT floor(min(time_s)) AS lo, CAST(ceil(max(time_s)) - floor(min(time_s)) AS BIGINT) + 1 AS n FROM samples),
grid AS (SELECT CAST(kk AS BIGINT) AS i, lo + kk AS time_s FROM gb, range(0, 20000) t(kk) WHERE kk < n),
fp AS (SELECT floor(time_s) AS b, arg_min(phase_id, time_s) AS phase_id, arg_min(scenario_name, time_s) AS sc FROM samples GROUP BY 1),
gp AS (SELECT g.i, g.time_s, f.phase_id, f.sc FROM grid g LEFT JOIN fp f ON f.b = floor(g.time_s)),
ph AS (SELECT i, time_s,
  coalesce(last_value(phase_id IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING),
    first_value(phase_id IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS phase_id,
  coalesce(last_value(sc IGNORE NULLS) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING),
    first_value(sc IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS scenario_name FROM gp),
mn AS (SELECT CAST(floor(time_s - lo) AS BIGINT) AS i, avg(rsrp_serving_dbm) AS rsrp, avg(sinr_serving_db) AS sinr FROM samples, gb GROUP BY 1),
ct AS (SELECT g.i, {', '.join(f"count(*) FILTER (s.event_type = '{e}') AS {e}" for e in S.EVENT_TYPES)}
  FROM grid g JOIN samples s ON s.event_time_s > g.time_s - {WIN} AND s.event_time_s <= g.time_s GROUP BY 1),
wide AS (SELECT ph.*, mn.rsrp AS rsrp_serving_mean, mn.sinr AS sinr_serving_mean,
  coalesce(HO_ATTEMPT, 0) / {WIN} AS ho_rate_rolling,
  CASE WHEN coalesce(HO_SUCCESS + HO_FAIL, 0) > 0 THEN HO_SUCCESS / (HO_SUCCESS + HO_FAIL) END AS hosr_rolling,
  coalesce(PING_PONG, 0) / {WIN} AS ping_pong_rate_rolling, coalesce(RLF, 0) / {WIN} AS rlf_rate_rolling
  FROM ph LEFT JOIN mn USING (i) LEFT JOIN ct USING (i)),
streams AS ({' UNION ALL '.join(f"SELECT i, time_s, '{s}' AS stream_name, CAST({s} AS DOUBLE) AS value, phase_id, scenario_name FROM wide" for s in S.STREAM_NAMES)})"""


def streams(spark, d):
    t = A.telemetry(spark, d)
    return S.build_streams(t, t, 1.0, WIN)


@query(
    "r01_grid",
    f"WITH {STREAM_SQL} SELECT CAST(phase_id AS BIGINT) AS phase_id, scenario_name, count(*) AS n_points, round(min(time_s), 6) AS first_t, round(max(time_s), 6) AS last_t FROM ph GROUP BY 1, 2",
)
def q_grid(spark, d):
    t = A.telemetry(spark, d)
    lo, n = S.grid_bounds(t, 1.0)
    p = S.phase_at(t, S.grid(spark, lo, n, 1.0), 1.0)
    return tidy(
        p.groupBy("phase_id", "scenario_name").agg(
            F.count(F.lit(1)).alias("n_points"), F.min("time_s").alias("first_t"), F.max("time_s").alias("last_t")
        )
    )


@query("r06_streams_long", f"WITH {STREAM_SQL} SELECT stream_name, {i('phase_id')}, scenario_name, {r('time_s', 'value')} FROM streams")
def q_streams(spark, d):
    return tidy(streams(spark, d).drop("i"))


@query("r07_streams_wide", f"WITH {STREAM_SQL} SELECT {r('time_s', *S.STREAM_NAMES)} FROM wide")
def q_streams_wide(spark, d):
    return tidy(S.pivot_streams(streams(spark, d)))


@query(
    "r04_rolling_counts_uneven",
    f"WITH {STREAM_SQL} SELECT g.i, "
    + ", ".join(f"count(*) FILTER (s.event_type = '{e}') AS {e}" for e in S.EVENT_TYPES)
    + " FROM grid g JOIN samples s ON s.event_time_s > g.time_s - 2.5 AND s.event_time_s <= g.time_s GROUP BY 1",
)
def q_uneven(spark, d):
    t = A.telemetry(spark, d)
    lo, n = S.grid_bounds(t, 1.0)
    return tidy(S.rolling_counts(t, lo, n, 1.0, 2.5))


TAGS_SQL = "tags(stream_name, tags) AS (VALUES " + ", ".join(f"('{s}', {t})" for s, t in L.STREAM_TAGS.items()) + ")"


@query(
    "l05_stream_labels",
    f"WITH {STREAM_SQL}, {A.DRIFT_SQL}, {TAGS_SQL}, hit AS (SELECT s.i, s.stream_name, list_sort(list(DISTINCT drift_id)) AS ids FROM streams s JOIN tags USING (stream_name) "
    "JOIN drift d ON s.time_s >= d.start_time_s AND s.time_s < d.end_time_s AND list_has_any(tags.tags, string_split(d.affected_kpis, ',')) GROUP BY ALL) "
    "SELECT s.stream_name, round(s.time_s, 6) AS time_s, CAST(h.ids IS NOT NULL AS BIGINT) AS label_drift, coalesce(array_to_string(h.ids, ','), '') AS active_drift_ids "
    "FROM streams s LEFT JOIN hit h ON h.i = s.i AND h.stream_name = s.stream_name",
)
def q_stream_labels(spark, d):
    out = L.label_streams(streams(spark, d), A.drift_truth(spark))
    return tidy(out.select("stream_name", "time_s", "label_drift", "active_drift_ids"))


BITS_SQL = """
num AS (SELECT stream_name, time_s, value, row_number() OVER (PARTITION BY stream_name ORDER BY time_s) - 1 AS idx FROM streams WHERE value IS NOT NULL),
hd AS (SELECT stream_name, avg(value) AS m, coalesce(nullif(stddev_pop(value), 0), 1.0) AS sd FROM num WHERE idx < 30 GROUP BY 1 HAVING count(*) = 30),
zs AS (SELECT n.stream_name, n.time_s, round(abs(n.value - m) / sd, 9) AS z FROM num n JOIN hd USING (stream_name) WHERE n.idx >= 30)"""


@query("r13_binarised", f"WITH {STREAM_SQL}, {BITS_SQL} SELECT stream_name, count(*) AS n, CAST(sum(CAST(z >= 2.0 AS INTEGER)) AS BIGINT) AS n_error, round(min(time_s), 6) AS first_t FROM zs GROUP BY 1")
def q_bits(spark, d):
    b = D.binarise(streams(spark, d))
    return tidy(b.groupBy("stream_name").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("n_error"), F.min("time_s").alias("first_t")))


@query("r13_binarised_levels", f"WITH {STREAM_SQL} SELECT stream_name, CAST(sum(CAST(value >= 1.0 AS INTEGER)) AS BIGINT) AS n_high, CAST(sum(CAST(value <= 0.5 AS INTEGER)) AS BIGINT) AS n_low FROM streams WHERE value IS NOT NULL GROUP BY 1")
def q_levels(spark, d):
    s = materialise(streams(spark, d), "streams")
    hi = D.binarise(s, "high", 1.0).groupBy("stream_name").agg(F.sum("error").alias("n_high"))
    lo = D.binarise(s, "low", 0.5).groupBy("stream_name").agg(F.sum("error").alias("n_low"))
    return tidy(hi.join(lo, "stream_name"))


# --- reference against active windows ----------------------------------------------------------

TESTS_SQL = """
refv AS (SELECT stream_name, idx, value AS v FROM num WHERE idx < 60),
tst AS (SELECT stream_name, (idx - 123) // 5 AS test, idx AS e, time_s FROM num WHERE idx >= 123 AND (idx - 123) % 5 = 0),
act AS (SELECT t.stream_name, t.test, n.idx, n.value AS v FROM tst t JOIN num n ON n.stream_name = t.stream_name AND n.idx > t.e - 60 AND n.idx <= t.e),
gam AS (SELECT a.stream_name, 1.0 / greatest(coalesce(quantile_cont(pow(a.v - b.v, 2), 0.5) FILTER (a.v <> b.v), 1.0), 1e-9) AS g
  FROM refv a JOIN refv b USING (stream_name) GROUP BY 1),
kxx AS (SELECT a.stream_name, sum(exp(-g * pow(a.v - b.v, 2))) / (60 * 59) AS k FROM refv a JOIN refv b ON a.stream_name = b.stream_name AND a.idx <> b.idx
  JOIN gam ON gam.stream_name = a.stream_name GROUP BY 1),
kyy AS (SELECT a.stream_name, a.test, sum(exp(-g * pow(a.v - b.v, 2))) / (60 * 59) AS k FROM act a JOIN act b ON a.stream_name = b.stream_name AND a.test = b.test AND a.idx <> b.idx
  JOIN gam ON gam.stream_name = a.stream_name GROUP BY 1, 2),
kxy AS (SELECT a.stream_name, a.test, sum(exp(-g * pow(a.v - b.v, 2))) / (60 * 60) AS k FROM act a JOIN refv b ON a.stream_name = b.stream_name
  JOIN gam ON gam.stream_name = a.stream_name GROUP BY 1, 2),
both_v AS (SELECT stream_name, test, v, 0 AS a FROM act UNION ALL SELECT t.stream_name, t.test, f.v, 1 FROM tst t JOIN refv f USING (stream_name)),
st AS (SELECT stream_name, test, v, sum(a) AS na, sum(1 - a) AS nb FROM both_v GROUP BY 1, 2, 3),
cu AS (SELECT *, sum(na) OVER w / 60.0 - sum(nb) OVER w / 60.0 AS gap, lead(v) OVER w - v AS dx FROM st WINDOW w AS (PARTITION BY stream_name, test ORDER BY v)),
en AS (SELECT stream_name, test, sqrt(2 * sum(gap * gap * dx)) AS energy FROM cu GROUP BY 1, 2)"""


@query(
    "r14_mmd_energy_tests",
    f"WITH {STREAM_SQL}, {BITS_SQL}, {TESTS_SQL} SELECT t.stream_name, CAST(t.test AS BIGINT) AS test, round(t.time_s, 6) AS time_s, "
    "round(greatest(kxx.k + kyy.k - 2 * kxy.k, 0.0), 6) AS mmd2, round(energy, 6) AS energy FROM tst t JOIN kxx USING (stream_name) "
    "JOIN kyy ON kyy.stream_name = t.stream_name AND kyy.test = t.test JOIN kxy ON kxy.stream_name = t.stream_name AND kxy.test = t.test "
    "JOIN en ON en.stream_name = t.stream_name AND en.test = t.test",
)
def q_tests(spark, d):
    t = D.window_tests(D.reference_tests(streams(spark, d)), n_perm=0)
    wide = t.groupBy("stream_name", "test", "time_s").pivot("detector", ["MMD-batch", "Energy-batch"]).agg(F.first("statistic"))
    return tidy(wide.withColumnsRenamed({"MMD-batch": "mmd2", "Energy-batch": "energy"}))


@query("r16_permutation_tests")
def q_permutations(spark, d):
    return tidy(D.window_tests(D.reference_tests(streams(spark, d))))


@query(
    "r15_energy_distance",
    "WITH st AS (SELECT l_linestatus, l_extendedprice AS v, sum(CAST(l_returnflag = 'R' AS INTEGER)) AS na, sum(CAST(l_returnflag <> 'R' AS INTEGER)) AS nb FROM lineitem GROUP BY 1, 2), "
    "tot AS (SELECT l_linestatus, sum(na) AS ta, sum(nb) AS tb FROM st GROUP BY 1), "
    "cu AS (SELECT st.*, ta, tb, sum(na) OVER w / ta - sum(nb) OVER w / tb AS gap, lead(v) OVER w - v AS dx FROM st JOIN tot USING (l_linestatus) WINDOW w AS (PARTITION BY l_linestatus ORDER BY v)) "
    "SELECT l_linestatus, round(sqrt(2 * sum(gap * gap * dx)), 6) AS energy, CAST(max(ta) AS BIGINT) AS n_first, CAST(max(tb) AS BIGINT) AS n_second FROM cu GROUP BY 1",
)
def q_energy(spark, d):
    li = A.table(spark, d, "lineitem").select("l_linestatus", "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("side"))
    return tidy(D.energy_distance(li, ["l_linestatus"], "l_extendedprice", "side"))


# --- detectors: behavioural, rows only ---------------------------------------------------------


def _one(name):
    def run(spark, d):
        from ..functions.detectors import SEQUENTIAL

        return tidy(D.run_sequential(streams(spark, d), {name: SEQUENTIAL[name]}))

    return run


for _id, _name in (("r08_adwin", "ADWIN"), ("r09_kswin", "KSWIN"), ("r10_page_hinkley", "PageHinkley"), ("r11_ddm", "DDM"), ("r12_eddm", "EDDM")):
    query(_id)(_one(_name))


@query("r17_all_detectors")
def q_all(spark, d):
    return tidy(D.run_detectors(materialise(streams(spark, d), "streams")))


# --- firing-log metrics on a threshold log that SQL can rebuild --------------------------------

FIRE_SQL = f"""{STREAM_SQL}, {BITS_SQL}, {A.DRIFT_SQL},
fire AS (SELECT stream_name, 'z2' AS detector, time_s FROM zs WHERE z >= 2.0 UNION ALL SELECT stream_name, 'z3', time_s FROM zs WHERE z >= 3.0),
inst AS (SELECT *, drift_id || '#' || row_number() OVER (PARTITION BY drift_id ORDER BY start_time_s) AS drift_instance FROM drift),
lat AS (SELECT n.drift_instance, n.drift_id, n.start_time_s, n.end_time_s, dd.detector, ss.stream_name, min(f.time_s) AS detection_time_s,
  min(f.time_s) - n.start_time_s AS latency_s, CAST(min(f.time_s) IS NULL AS INTEGER) AS missed
  FROM inst n CROSS JOIN (SELECT DISTINCT detector FROM fire) dd CROSS JOIN (SELECT DISTINCT stream_name FROM fire) ss
  LEFT JOIN fire f ON f.detector = dd.detector AND f.stream_name = ss.stream_name AND f.time_s >= n.start_time_s AND f.time_s < n.end_time_s + 30.0 GROUP BY n.drift_instance, n.drift_id, n.start_time_s, n.end_time_s, dd.detector, ss.stream_name),
typed AS (SELECT *, CASE drift_id {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in A.DRIFT_TYPES.items())} ELSE 'other' END AS drift_type FROM lat)"""


def firings(spark, d):
    s = materialise(streams(spark, d), "streams")
    b2, b3 = (D.binarise(s, z=z).where("error = 1").select("stream_name", F.lit(n).alias("detector"), "time_s") for n, z in (("z2", 2.0), ("z3", 3.0)))
    return s, materialise(b2.unionByName(b3), "firings")


@query("r18_detection_latency", f"WITH {FIRE_SQL} SELECT drift_instance, drift_id, detector, stream_name, {r('start_time_s', 'end_time_s', 'detection_time_s', 'latency_s')}, {i('missed')} FROM lat")
def q_latency(spark, d):
    _, f = firings(spark, d)
    return tidy(D.detection_latency(f, A.drift_truth(spark)))


@query(
    "r19_false_alarms",
    f"WITH {FIRE_SQL}, bud AS (SELECT stream_name, count(*) AS n FROM streams WHERE scenario_name = 'baseline' GROUP BY 1), "
    "fa AS (SELECT f.detector, f.stream_name, count(b.time_s) AS k FROM fire f LEFT JOIN streams b ON b.stream_name = f.stream_name AND b.scenario_name = 'baseline' AND round(b.time_s, 6) = round(f.time_s, 6) GROUP BY 1, 2) "
    "SELECT detector, stream_name, n AS n_baseline_s, k AS n_false_alarms, round(k / n, 6) AS fpr_per_s FROM fa JOIN bud USING (stream_name)",
)
def q_fpr(spark, d):
    s, f = firings(spark, d)
    return tidy(D.false_alarm_rate(f, s))


REPS = 1000


def _median_boot(reps: int) -> str:
    return f"""
med AS (SELECT detector, drift_type, stream_name, quantile_cont(latency_s, 0.5) AS m FROM typed WHERE latency_s IS NOT NULL GROUP BY 1, 2, 3),
best AS (SELECT detector, drift_type, stream_name AS best_stream FROM med QUALIFY row_number() OVER (PARTITION BY detector, drift_type ORDER BY m, stream_name) = 1),
ch AS (SELECT t.detector, t.drift_type, t.latency_s AS v FROM typed t JOIN best b ON b.detector = t.detector AND b.drift_type = t.drift_type AND b.best_stream = t.stream_name WHERE t.latency_s IS NOT NULL),
pz AS (SELECT *, row_number() OVER (PARTITION BY detector, drift_type ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY detector, drift_type) AS n FROM ch),
dr AS (SELECT detector, drift_type, rep, ('0x' || substr(md5(rep || '|' || detector || '|' || drift_type || '|' || pos), 1, 8))::UBIGINT % n AS pos FROM pz, range(0, {reps}) t(rep)),
mb AS (SELECT d.detector, d.drift_type, d.rep, quantile_cont(p.v, 0.5) AS b FROM dr d JOIN pz p USING (detector, drift_type, pos) GROUP BY 1, 2, 3),
ci AS (SELECT detector, drift_type, quantile_cont(b, 0.025) AS ci_low_s, quantile_cont(b, 0.975) AS ci_high_s FROM mb GROUP BY 1, 2),
pt AS (SELECT detector, drift_type, quantile_cont(v, 0.5) AS median_latency_s FROM ch GROUP BY 1, 2),
smry AS (SELECT t.*, coalesce(best_stream, '<none>') AS best_stream, median_latency_s, ci_low_s, ci_high_s FROM
  (SELECT detector, drift_type, count(DISTINCT drift_instance) AS n_drifts, count(*) FILTER (missed = 0) AS n_detected, avg(missed) AS miss_rate FROM typed GROUP BY 1, 2) t
  LEFT JOIN best USING (detector, drift_type) LEFT JOIN pt USING (detector, drift_type) LEFT JOIN ci USING (detector, drift_type))"""


SUMMARY_SQL = f"{FIRE_SQL}, {_median_boot(REPS)}"


def summary(spark, d):
    s, f = firings(spark, d)
    lat = materialise(D.detection_latency(f, A.drift_truth(spark)), "latency")
    return s, f, lat, D.latency_summary(lat, A.DRIFT_TYPES, reps=REPS)


@query("r20_latency_summary", f"WITH {SUMMARY_SQL} SELECT detector, drift_type, best_stream, {i('n_drifts', 'n_detected')}, {r('miss_rate', 'median_latency_s', 'ci_low_s', 'ci_high_s')} FROM smry")
def q_summary(spark, d):
    return tidy(summary(spark, d)[3])


@query(
    "r21_miss_rates",
    f"WITH {FIRE_SQL}, im AS (SELECT detector, drift_type, drift_instance, min(missed) AS m FROM typed GROUP BY 1, 2, 3) SELECT detector, drift_type, count(*) AS n_drifts, CAST(sum(m) AS BIGINT) AS n_missed, round(avg(m), 6) AS miss_rate FROM im GROUP BY 1, 2",
)
def q_miss(spark, d):
    _, f = firings(spark, d)
    return tidy(D.miss_rates(D.detection_latency(f, A.drift_truth(spark)), A.DRIFT_TYPES))


@query(
    "r22_winner",
    f"WITH {SUMMARY_SQL}, w AS (SELECT detector, avg(coalesce(median_latency_s, 60.0)) AS m FROM smry GROUP BY 1) SELECT detector AS winner, round(m, 6) AS mean_latency_s FROM w ORDER BY m, detector LIMIT 1",
)
def q_winner(spark, d):
    return tidy(D.winning_detector(summary(spark, d)[3]))


TYPES = list(A.DRIFT_TYPES.values())


@query(
    "r23_latency_matrix",
    f"WITH {SUMMARY_SQL}, bud AS (SELECT stream_name, count(*) AS n FROM streams WHERE scenario_name = 'baseline' GROUP BY 1), "
    "fa AS (SELECT f.detector, f.stream_name, count(b.time_s) AS k FROM fire f LEFT JOIN streams b ON b.stream_name = f.stream_name AND b.scenario_name = 'baseline' AND round(b.time_s, 6) = round(f.time_s, 6) GROUP BY 1, 2), "
    "mf AS (SELECT detector, max(k / n) AS max_fpr FROM fa JOIN bud USING (stream_name) GROUP BY 1) "
    f"SELECT detector, {', '.join(f'round(max(median_latency_s) FILTER (drift_type = {chr(39)}{t}{chr(39)}), 6) AS {t}' for t in TYPES)}, round(max_fpr, 6) AS max_fpr FROM smry JOIN mf USING (detector) GROUP BY detector, max_fpr",
)
def q_matrix(spark, d):
    s, f, _, smry = summary(spark, d)
    worst = D.false_alarm_rate(f, s).groupBy("detector").agg(F.max("fpr_per_s").alias("max_fpr"))
    return tidy(D.latency_matrix(smry, TYPES).join(worst, "detector"))
