"""Radio-telemetry tables derived from the generic event table (see FIXTURES.md section 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the fixture: one day is a phase, one hour a time unit.
SCENARIOS = {
    5: "drift_channel_swap", 17: "drift_channel_swap",
    8: "drift_mobility", 20: "drift_mobility",
    11: "drift_reconfig", 14: "drift_reconfig",
    23: "drift_traffic_shift", 26: "drift_traffic_shift",
}
EVENT_NAMES = {"click": "HO_ATTEMPT", "view": "HO_SUCCESS", "error": "HO_FAIL", "purchase": "RLF", "signup": "PING_PONG"}
ANOMALY_ROWS = [
    ("A-1", "rlf_burst", 4, 74.0, 80.0, "1,3,5", "all", -12.0),
    ("A-2", "meas_glitch", 7, 150.0, 157.5, "2,4", "all", -80.0),
    ("A-3", "interference_spike", 9, 194.0, 206.0, "all", "3,4", -8.0),
    ("A-4", "slow_degrade", 13, 290.0, 310.0, "0, 7", "", 0.02),
    ("A-5", "rlf_burst", 16, 362.5, 366.0, "ALL", None, -15.0),
    ("A-6", "meas_glitch", 19, 436.0, 444.0, "6,8,9", "all", None),
    ("A-7", "interference_spike", 22, 505.0, 520.0, "all", "3,4", -6.0),
    ("A-9", "meas_glitch", 11, 249.0, 258.0, "all", "all", -30.0),
    ("A-8", "slow_degrade", 27, 626.0, 646.0, "1", "all", 0.03),
]
DRIFT_TAGS = {
    "D-1": "event_rate,ho_rate,rlf_rate",
    "D-2": "rsrp_serving_dbm,sinr_serving_db,rsrq_serving_db",
    "D-3": "ho_rate,dwell_time_s,ping_pong_rate",
    "D-4": "hosr,ho_rate,ping_pong_rate,rlf_rate",
}
DRIFT_OF = {"drift_traffic_shift": "D-1", "drift_channel_swap": "D-2", "drift_mobility": "D-3", "drift_reconfig": "D-4"}
DRIFT_TYPES = {"D-1": "traffic_shift", "D-2": "channel_swap", "D-3": "mobility", "D-4": "reconfig"}
DRIFT_ROWS = [
    (DRIFT_OF[s], p, p, 24.0 * (p - 1), 24.0 * p, DRIFT_TAGS[DRIFT_OF[s]]) for p, s in sorted(SCENARIOS.items())
]
ANOMALY_SCHEMA = (
    "anomaly_id string, anomaly_type string, phase_id int, t_start_s double, t_end_s double, "
    "affected_ue_ids string, affected_cell_ids string, severity double"
)
DRIFT_SCHEMA = (
    "drift_id string, phase_id_start int, phase_id_end int, start_time_s double, end_time_s double, affected_kpis string"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event row with the measurement and configuration columns of a telemetry sample."""
    return telemetry_of(table(spark, sf_dir, "events"))


def telemetry_of(e: DataFrame) -> DataFrame:
    """The same columns for any event table, batch or stream."""
    scenario = " ".join(f"WHEN phase_id = {p} THEN '{n}'" for p, n in SCENARIOS.items())
    kind = " ".join(f"WHEN '{raw}' THEN '{n}'" for raw, n in EVENT_NAMES.items())
    d = e.selectExpr(
        "event_id", "ts", "user_id", "user_id % 10 as ue_id", "event_type as _kind", "least(value, 96.0D) - 140.0D as rsrp_serving_dbm",
        "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 3.6e9D as time_s", "cast(get_json_object(props, '$.k') as int) as k",
    )
    d = d.selectExpr("*", "cast(floor(time_s / 24) as int) + 1 as phase_id", "(k % 34) * 0.5D - 19.5D as rsrq_serving_db")
    return d.selectExpr(
        "event_id", "ts", "user_id", "ue_id", "time_s", "time_s as event_time_s", "phase_id",
        f"CASE {scenario} ELSE 'baseline' END as scenario_name", f"CASE _kind {kind} END as event_type", "k",
        "rsrp_serving_dbm", "rsrq_serving_db", "k * 0.25D - 5.0D as sinr_serving_db", "k % 19 as serving_cell_id", "(k + 7) % 19 as neighbor_cell_id",
        "rsrp_serving_dbm - (k % 7) as rsrp_neighbor_dbm", "rsrq_serving_db - 1.0D as rsrq_neighbor_db", "5.0D + (user_id % 5) * 5.0D as ue_speed_mps",
        "CASE WHEN phase_id IN (11, 14) THEN 1024.0D ELSE 256.0D END as cfg_ttt_ms", "CASE WHEN phase_id IN (11, 14) THEN 4.0D ELSE 2.0D END as cfg_hyst_db",
        "0.0D as cfg_a3_off_db",
    )


samples = telemetry
events = telemetry


def anomaly_truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ANOMALY_ROWS, ANOMALY_SCHEMA)


def drift_truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DRIFT_ROWS, DRIFT_SCHEMA)


def _sql(v) -> str:
    return "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else repr(v))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_sql(v) for v in r) + ")" for r in rows)


# The same tables for the SQL oracle.
SAMPLES_SQL = f"""
raw AS (SELECT *, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS time_s,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
tele AS (SELECT event_id, user_id, user_id % 10 AS ue_id, time_s, time_s AS event_time_s,
  CAST(floor(time_s / 24) AS INTEGER) + 1 AS phase_id, k,
  CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in EVENT_NAMES.items())} END AS event_type,
  CAST(least(value, 96.0) - 140.0 AS DOUBLE) AS rsrp_serving_dbm, CAST((k % 34) * 0.5 - 19.5 AS DOUBLE) AS rsrq_serving_db,
  CAST(k * 0.25 - 5.0 AS DOUBLE) AS sinr_serving_db, k % 19 AS serving_cell_id, (k + 7) % 19 AS neighbor_cell_id,
  CAST(least(value, 96.0) - 140.0 - (k % 7) AS DOUBLE) AS rsrp_neighbor_dbm, CAST((k % 34) * 0.5 - 20.5 AS DOUBLE) AS rsrq_neighbor_db,
  CAST(5.0 + (user_id % 5) * 5.0 AS DOUBLE) AS ue_speed_mps FROM raw),
samples AS (SELECT *, CASE {' '.join(f"WHEN phase_id = {p} THEN '{s}'" for p, s in SCENARIOS.items())} ELSE 'baseline' END AS scenario_name,
  CAST(CASE WHEN phase_id IN (11, 14) THEN 1024.0 ELSE 256.0 END AS DOUBLE) AS cfg_ttt_ms,
  CAST(CASE WHEN phase_id IN (11, 14) THEN 4.0 ELSE 2.0 END AS DOUBLE) AS cfg_hyst_db, CAST(0.0 AS DOUBLE) AS cfg_a3_off_db FROM tele)"""
TRUTH_SQL = f"""
truth_raw(anomaly_id, anomaly_type, phase_id, t_start_s, t_end_s, ues, cells, severity) AS (VALUES {_values(ANOMALY_ROWS)}),
truth AS (SELECT anomaly_id, anomaly_type, phase_id, t_start_s AS a_start, t_end_s AS a_end, severity,
  CASE WHEN ues IS NULL OR lower(trim(ues)) IN ('', 'all') THEN NULL
    ELSE list_transform(string_split(ues, ','), lambda x: CAST(trim(x) AS INTEGER)) END AS a_ues,
  CASE WHEN cells IS NULL OR lower(trim(cells)) IN ('', 'all') THEN NULL
    ELSE list_transform(string_split(cells, ','), lambda x: CAST(trim(x) AS INTEGER)) END AS a_cells FROM truth_raw)"""
DRIFT_SQL = f"""
drift(drift_id, phase_id_start, phase_id_end, start_time_s, end_time_s, affected_kpis) AS (VALUES {_values(DRIFT_ROWS)})"""


def windows_sql(sizes=((6.0, 1.0),)) -> str:
    """CTEs for every window of every (ue, phase): names ``win`` (bounds) and ``samples``."""
    return f"""{SAMPLES_SQL},
sizes(window_s, slide_s) AS (VALUES {_values(sizes)}),
bnd AS (SELECT ue_id, phase_id, min(time_s) AS t_min, max(time_s) AS t_max,
  arg_min(scenario_name, time_s) AS scenario_name FROM samples GROUP BY 1, 2),
win AS (SELECT ue_id, phase_id, scenario_name, window_s, CAST(kk AS BIGINT) AS window_id,
  t_min + kk * slide_s AS t_start_s, t_min + kk * slide_s + window_s AS t_end_s
  FROM bnd, sizes, range(0, 40) r(kk) WHERE t_min + kk * slide_s < t_max - window_s + 1e-9)"""


def _feature_sql() -> str:
    from ..operators.windows import EVENT_TYPES, QUANTILES, SAMPLE_COLUMNS

    parts = []
    for c in SAMPLE_COLUMNS:
        parts += [f"quantile_cont(s.{c}, {p}) AS {c}__{n}" for n, p in QUANTILES.items()]
        parts.append(f"stddev_pop(s.{c}) AS {c}__std")
    parts += [f"count(CASE WHEN s.event_type = '{e}' THEN 1 END) AS n_{e.lower()}" for e in EVENT_TYPES]
    return ", ".join(parts)


def features_sql(sizes=((6.0, 1.0),)) -> str:
    """CTEs up to ``feat``: the full feature table (events and samples share the source rows)."""
    return f"""{windows_sql(sizes)},
agg AS (SELECT w.ue_id, w.phase_id, any_value(w.scenario_name) AS scenario_name, w.window_s, w.window_id, w.t_start_s, w.t_end_s,
  {_feature_sql()} FROM win w JOIN samples s ON s.ue_id = w.ue_id AND s.phase_id = w.phase_id
  AND s.time_s >= w.t_start_s AND s.time_s < w.t_end_s GROUP BY ALL),
cellcount AS (SELECT w.ue_id, w.phase_id, w.window_s, w.window_id, s.serving_cell_id AS cell, count(*) AS n
  FROM win w JOIN samples s ON s.ue_id = w.ue_id AND s.phase_id = w.phase_id
  AND s.time_s >= w.t_start_s AND s.time_s < w.t_end_s GROUP BY ALL),
modal AS (SELECT ue_id, phase_id, window_s, window_id, cell AS serving_cell_mode FROM cellcount
  QUALIFY row_number() OVER (PARTITION BY ue_id, phase_id, window_s, window_id ORDER BY n DESC, cell) = 1),
feat AS (SELECT a.*, m.serving_cell_mode, a.t_start_s + a.window_s / 2 AS t_mid_s,
  CASE WHEN n_ho_success + n_ho_fail > 0 THEN n_ho_success / (n_ho_success + n_ho_fail) END AS hosr,
  n_ho_fail / a.window_s AS hofr_rate, n_rlf / a.window_s AS rlf_rate, n_ping_pong / a.window_s AS ping_pong_rate
  FROM agg a JOIN modal m USING (ue_id, phase_id, window_s, window_id))"""


def labelled_sql(sizes=((6.0, 1.0),)) -> str:
    """CTEs up to ``lab``: features with the sorted list of active anomaly ids and the 0/1 label."""
    return f"""{features_sql(sizes)}, {TRUTH_SQL},
hit AS (SELECT f.ue_id, f.phase_id, f.window_s, f.window_id, list_sort(list(DISTINCT t.anomaly_id)) AS ids
  FROM feat f JOIN truth t ON f.t_start_s < t.a_end AND t.a_start < f.t_end_s
  AND (t.a_ues IS NULL OR list_contains(t.a_ues, CAST(f.ue_id AS INTEGER)))
  AND (t.a_cells IS NULL OR list_contains(t.a_cells, f.serving_cell_mode)) GROUP BY ALL),
lab AS (SELECT f.*, coalesce(h.ids, []) AS ids, CAST(coalesce(len(h.ids), 0) > 0 AS INTEGER) AS label_anomaly
  FROM feat f LEFT JOIN hit h USING (ue_id, phase_id, window_s, window_id))"""
