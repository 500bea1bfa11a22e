import numpy as np
import pandas as pd
import pytest

from wavegauge.operators import labels as L
from wavegauge.operators import windows as W


def make_samples(spark, n=300, dt=0.1, ues=(1, 2), phase=lambda t: 1):
    rng = np.random.default_rng(0)
    rows = []
    for u in ues:
        for i in range(n + 1):
            t = round(i * dt, 6)
            rows.append((u, t, phase(t), "baseline", int(rng.integers(1, 3)), *rng.normal([-90, -10, 10, -95, -12], 2).tolist(), 10.0))
    return pd.DataFrame(rows, columns=["ue_id", "time_s", "phase_id", "scenario_name", "serving_cell_id", *W.SAMPLE_COLUMNS])


EVENTS = pd.DataFrame([(1, float(t), "HO_ATTEMPT", 1) for t in (1, 6, 11, 16, 21, 26)], columns=["ue_id", "event_time_s", "event_type", "phase_id"])


def test_window_count_and_values(spark):
    s = make_samples(spark)
    got = W.window_features(spark.createDataFrame(s), spark.createDataFrame(EVENTS), 5.0, 1.0).toPandas()
    assert (got.groupby("ue_id").size() == 25).all() or (got.groupby("ue_id").size() == 26).all()
    r = got[(got.ue_id == 1) & (got.window_id == 3)].iloc[0]
    x = s[(s.ue_id == 1) & (s.time_s >= r.t_start_s) & (s.time_s < r.t_end_s)]
    for c in W.SAMPLE_COLUMNS:
        assert np.isclose(r[f"{c}__p10"], np.quantile(x[c], 0.1)) and np.isclose(r[f"{c}__std"], x[c].std(ddof=0))
    values, counts = np.unique(x.serving_cell_id, return_counts=True)
    assert r.serving_cell_mode == values[counts.argmax()]


def test_starts_follow_arange(spark):
    s = make_samples(spark, n=30, dt=1.0)
    got = W.window_features(spark.createDataFrame(s), spark.createDataFrame(EVENTS), 5.0, 1.0).toPandas()
    want = np.arange(0.0, 30.0 - 5.0 + 1e-9, 1.0)
    assert sorted(got[got.ue_id == 1].t_start_s) == want.tolist() and len(want) == 26


def test_tumbling_attempts_sum(spark):
    s = make_samples(spark)
    got = W.window_features(spark.createDataFrame(s), spark.createDataFrame(EVENTS), 5.0, 5.0).toPandas()
    assert got.n_ho_attempt.sum() == 6 and got.hosr.isna().all()


def test_windows_never_mix_phases(spark):
    s = make_samples(spark, phase=lambda t: 1 if t < 10 else 2)
    got = W.window_features(spark.createDataFrame(s), spark.createDataFrame(EVENTS), 5.0, 1.0).toPandas()
    assert (got[got.phase_id == 1].t_end_s <= 10.01).all() and (got[got.phase_id == 2].t_start_s >= 9.99).all()


def test_hot_windows_give_the_same(spark):
    s, e = spark.createDataFrame(make_samples(spark)), spark.createDataFrame(EVENTS)
    a = W.window_features(s, e, 5.0, 1.0).toPandas().sort_values(["ue_id", "window_id"])
    b = W.window_features(s, e, 5.0, 1.0, hot_rows=0).toPandas().sort_values(["ue_id", "window_id"])
    for c in W.feature_columns():
        assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True), c


def test_short_series_and_contract(spark):
    s = spark.createDataFrame(make_samples(spark, n=10))
    e = spark.createDataFrame([], "ue_id long, event_time_s double, event_type string, phase_id int")
    out = W.window_features(s, e, 5.0, 1.0)
    assert out.count() == 0 and set(W.feature_columns()) <= set(out.columns)
    with pytest.raises(ValueError, match="slide"):
        W.window_features(s, e, 1.0, 2.0)
    with pytest.raises(ValueError, match="ue_speed_mps"):
        W.window_features(s.drop("ue_speed_mps"), e)


def test_families_partition():
    fam = W.feature_families()
    assert sum(len(v) for v in fam.values()) == 34 == len(W.feature_columns()) and len(fam) == 7
    assert len(W.drop_family_sets()["drop_rsrq"]) == 26


WIN = [(u, 1, float(t), float(t + 5), i, c) for u in (1, 2, 3) for i, (t, c) in enumerate(zip((0, 5, 10, 15), (1, 2, 3, 4)))]
WSCHEMA = "ue_id long, phase_id int, t_start_s double, t_end_s double, window_id long, serving_cell_mode int"
TSCHEMA = "anomaly_id string, anomaly_type string, phase_id int, t_start_s double, t_end_s double, affected_ue_ids string, affected_cell_ids string"


@pytest.mark.parametrize("others", [0, 513])
@pytest.mark.parametrize(
    "truth, expected",
    [
        (("A", "x", 1, 5.0, 5.001, "all", "all"), {(u, 5.0) for u in (1, 2, 3)}),
        (("A", "x", 1, 6.0, 9.0, "2", "all"), {(2, 5.0)}),
        (("A", "x", 1, 0.0, 20.0, " 1 , 3 ", "2"), {(1, 5.0), (3, 5.0)}),
        (("A", "x", 1, 4.0, 5.0, "ALL", ""), {(u, 0.0) for u in (1, 2, 3)}),
        (("A", "x", 1, 20.0, 30.0, None, None), set()),
    ],
)
def test_label_rules(spark, others, truth, expected):
    rows = [truth] + [(f"Z{i}", "x", 1, 1e4 + i, 1e4 + i + 3, "all", "all") for i in range(others)]
    for columns in (WSCHEMA.split(", "), [c for c in WSCHEMA.split(", ") if not c.startswith("window_id")]):
        windows = spark.createDataFrame(WIN, WSCHEMA).select(*[c.split()[0] for c in columns])
        got = L.label_windows(windows, spark.createDataFrame(rows, TSCHEMA)).where("label_anomaly = 1").collect()
        assert sorted((r["ue_id"], r["t_start_s"]) for r in got) == sorted(expected)


def test_labels_without_truth_and_with_open_ends(spark):
    w = spark.createDataFrame([*WIN, (9, 1, None, None, 0, 1)], WSCHEMA)
    assert L.label_windows(w, spark.createDataFrame([], TSCHEMA)).where("label_anomaly = 0").count() == len(WIN) + 1
    t = spark.createDataFrame([("A", "x", 1, 10.0, float("inf"), "all", "all"), ("B", "x", 1, float("-inf"), 1.0, "1", "all"), ("C", "x", 1, 9.0, 2.0, "all", "all")], TSCHEMA)
    got = L.label_windows(w, t).where("label_anomaly = 1").collect()
    assert sorted((r["ue_id"], r["t_start_s"]) for r in got) == sorted([(1, 0.0)] + [(u, x) for u in (1, 2, 3) for x in (10.0, 15.0)])


def test_long_rows_are_refused_on_demand(spark):
    w, t = spark.createDataFrame(WIN, WSCHEMA), spark.createDataFrame([("A", "x", 1, 5.0, 6.0, "all", "all")], TSCHEMA)
    assert L.label_windows(w, t, longest_s=5.0).where("label_anomaly = 1").count() == 3
    with pytest.raises(Exception, match="longer than"):
        L.label_windows(w, t, longest_s=4.0).collect()


def test_two_faults_join_ids(spark):
    t = [("B", "x", 1, 0.0, 6.0, "all", "all"), ("A", "y", 1, 5.0, 7.0, "1", "all")]
    got = {(r["ue_id"], r["t_start_s"]): r["active_anomaly_id"] for r in L.label_windows(spark.createDataFrame(WIN, WSCHEMA), spark.createDataFrame(t, TSCHEMA)).collect()}
    assert got[1, 5.0] == "A,B" and got[2, 5.0] == "B" and got[3, 15.0] == ""


def test_stream_labels_half_open(spark):
    s = spark.createDataFrame([("hosr_rolling", float(t)) for t in (99, 100, 159, 160)] + [("rlf_rate_rolling", 120.0)], "stream_name string, time_s double")
    d = spark.createDataFrame([("D-1", 100.0, 160.0, "hosr,dwell_time_s")], "drift_id string, start_time_s double, end_time_s double, affected_kpis string")
    got = {(r["stream_name"], r["time_s"]): r["label_drift"] for r in L.label_streams(s, d).collect()}
    assert [got["hosr_rolling", t] for t in (99.0, 100.0, 159.0, 160.0)] == [0, 1, 1, 0] and got["rlf_rate_rolling", 120.0] == 0
