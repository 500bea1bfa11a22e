import numpy as np
import pandas as pd
import pytest

from wavegauge.functions import detectors as D
from wavegauge.operators import drift as R
from wavegauge.operators import streams as S


def shifted(n=400, at=200, size=4.0, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, n)
    x[at:] += size
    return x


@pytest.mark.parametrize("name, kwargs", [("ADWIN", {}), ("KSWIN", {}), ("PageHinkley", {"threshold": 30.0}), ("DDM", {}), ("EDDM", {})])
def test_shift_is_found(name, kwargs):
    det = D.SEQUENTIAL[name](**kwargs)
    x = shifted(1200, 600) if name != "EDDM" else np.r_[np.tile([0.0] * 9 + [9.0], 60), np.full(200, 9.0)]
    fired = [i for i, v in enumerate(x) if det.update(v)]
    assert any(i >= 600 for i in fired), fired


def test_adwin_quiet_on_constant_and_noise():
    det = D.Adwin()
    assert not any(det.update(5.0) for _ in range(500))
    det = D.Adwin(delta=0.002)
    assert sum(det.update(v) for v in np.random.default_rng(3).normal(0, 1, 2000)) <= 1


def test_adwin_keeps_exact_totals():
    x = shifted(900, 450)
    det = D.Adwin()
    for v in x:
        det.update(v)
    tail = x[len(x) - det.n :]
    assert np.isclose(det.total, tail.sum()) and np.isclose(det.dev, ((tail - tail.mean()) ** 2).sum(), rtol=1e-6)


def test_statistics_against_definitions():
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 60), rng.normal(0.7, 1.3, 60)
    pair = lambda x, y: np.abs(x[:, None] - y[None, :]).mean()
    want = 2 * pair(a, b) - pair(a, a) - pair(b, b)
    assert np.isclose(float(D.energy(a, b)[0]) ** 2, want)
    g = D.rbf_gamma(a)
    k = lambda x, y: np.exp(-g * (x[:, None] - y[None, :]) ** 2)
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    assert np.isclose(float(D.mmd2(a, b, g)[0]), max(off(k(a, a)) + off(k(b, b)) - 2 * k(a, b).mean(), 0))


def _stream(spark, x, name="s", nulls=()):
    rows = [(name, float(t), None if t in nulls else float(v)) for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "stream_name string, time_s double, value double")


def test_nulls_do_not_change_firings(spark):
    x = shifted()
    a = R.run_sequential(_stream(spark, x)).toPandas()
    spread = np.repeat(x, 2)
    b = R.run_sequential(_stream(spark, spread, nulls=set(range(1, 2 * len(x), 2)))).toPandas()
    assert sorted(zip(a.detector, a.time_s * 2)) == sorted(zip(b.detector, b.time_s))


def test_batch_tests_fire_after_shift_only(spark):
    out = R.window_tests(R.reference_tests(_stream(spark, shifted(400, 250)))).toPandas()
    first = out.time_s.min()
    assert first == 60 + 60 - 1 + 4
    hit = out[out.p_value < 0.01]
    assert (hit[hit.time_s > 320].groupby("detector").size() == out[out.time_s > 320].groupby("detector").size()).all()
    assert len(hit[hit.time_s < 240]) <= 2


def test_latency_boundaries(spark):
    drift = spark.createDataFrame([("D-1", 100.0, 160.0)], "drift_id string, start_time_s double, end_time_s double")
    f = spark.createDataFrame([("ADWIN", "hosr_rolling", t) for t in (105.0, 120.0)], "detector string, stream_name string, time_s double")
    assert R.detection_latency(f, drift).first()["latency_s"] == 5.0
    late = spark.createDataFrame([("ADWIN", "hosr_rolling", t) for t in (50.0, 300.0)], f.schema)
    row = R.detection_latency(late, drift).first()
    assert row["missed"] == 1 and row["latency_s"] is None
    edge = spark.createDataFrame([("ADWIN", "hosr_rolling", 190.0)], f.schema)
    assert R.detection_latency(edge, drift).first()["missed"] == 1


def test_no_firings_report_none(spark):
    s = spark.createDataFrame([("a", 1.0, "baseline"), ("a", 2.0, "drift_x")], "stream_name string, time_s double, scenario_name string")
    f = spark.createDataFrame([], R.FIRING_SCHEMA)
    r = R.false_alarm_rate(f, s).first()
    assert (r["detector"], r["n_baseline_s"], r["fpr_per_s"]) == ("<none>", 1, 0.0)


def test_stream_grid_and_hosr(spark):
    t = [round(i * 0.5, 3) for i in range(41)]
    s = spark.createDataFrame([(1, x, 1, "baseline", 1, -90.0, 10.0) for x in t], "ue_id long, time_s double, phase_id int, scenario_name string, serving_cell_id int, rsrp_serving_dbm double, sinr_serving_db double")
    e = spark.createDataFrame([(x, k) for x, k in [(1.0, "HO_SUCCESS"), (4.0, "HO_SUCCESS"), (10.0, "HO_SUCCESS"), (6.0, "HO_FAIL"), (0.0, "HO_FAIL")]], "event_time_s double, event_type string")
    got = S.build_streams(s, e, 1.0, 10.0).toPandas().pivot(index="time_s", columns="stream_name", values="value")
    assert len(got) == 21 and got.loc[10.0, "hosr_rolling"] == 0.75
    assert pd.isna(got.loc[20.0, "hosr_rolling"]) and got.loc[5.0, "ho_rate_rolling"] == 0.0
    with pytest.raises(ValueError):
        S.build_streams(s, e, 2.0, 1.0)
