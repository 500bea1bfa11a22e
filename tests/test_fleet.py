"""Fleet series of several segments against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavegauge.operators import fleet as FL

KEYS = ["operator_id", "ran_type"]


def feed(spark):
    g = np.random.default_rng(4)
    rows = []
    for op, ran, n in ((1, "LTE", 300), (2, "LTE", 200), (1, "NR", 40), (None, "LTE", 30)):
        t = np.sort(g.random(n) * n)
        for i in range(n):
            rows.append((op, ran, "b", float(t[i]), int(g.integers(0, 4)), float(g.normal(-90, 4)), float(g.normal(10, 3))))
    return spark.createDataFrame(rows, "operator_id int, ran_type string, band string, time_s double, serving_cell_id int, rsrp_serving_dbm double, sinr_serving_db double")


def test_segments_equal_one_at_a_time(spark):
    df = feed(spark)
    together = FL.fleet_streams(df, 5.0, 30.0, 20.0, keys=KEYS)
    windows = FL.fleet_windows(together, 5.0, 30.0, 10.0, KEYS)
    hours = FL.hourly_counts(together.withColumn("t_center_s", F.col("t_s")), together, 5.0, keys=KEYS)
    for op, ran in ((1, "LTE"), (2, "LTE"), (1, "NR")):
        own = F.expr(f"operator_id = {op} AND ran_type = '{ran}'")
        alone = FL.fleet_streams(df.where(own), 5.0, 30.0, 20.0)
        series = {r["i"]: r for r in together.where(own).drop(*KEYS).collect()}
        plain = {r["i"]: r for r in alone.collect()}
        assert series.keys() == plain.keys() and all(tuple(series[i]) == pytest.approx(tuple(plain[i])) for i in plain)
        want = {r["k"]: r for r in FL.fleet_windows(alone, 5.0, 30.0, 10.0).collect()}
        got = {r["k"]: r for r in windows.where(own).drop(*KEYS).collect()}
        assert got.keys() == want.keys() and all(tuple(got[k]) == pytest.approx(tuple(want[k])) for k in want)
        assert hours.where(own).agg(F.sum("n")).first()[0] == alone.count()
    assert together.where("operator_id is null").isEmpty()


def test_anomaly_scores_of_each_segment(spark):
    windows = FL.fleet_windows(FL.fleet_streams(feed(spark), 5.0, 30.0, 20.0, keys=KEYS), 5.0, 30.0, 10.0, KEYS).cache()
    got = {(r["operator_id"], r["ran_type"], r["k"]): r for r in FL.fleet_anomalies(windows, 100.0, keys=KEYS).collect()}
    p = windows.toPandas()
    cols = [c for c in windows.columns if c.endswith(("__mean", "__std"))]
    assert len(got) == len(p)
    for key, seg in p.groupby(KEYS):
        early = seg["t_center_s"] < 100.0
        train = early if early.sum() >= 5 else seg["k"] < max(5, len(seg) // 2)
        x = seg[cols].to_numpy()
        mean = x[train].mean(0)
        basis = np.linalg.eigh(np.cov(x[train].T, bias=True))[1][:, ::-1][:, :2]
        z = x - mean
        score = np.linalg.norm(z - z @ basis @ basis.T, axis=1)
        limit = np.quantile(score[train], 0.99)
        for k, s, t in zip(seg["k"], score, train):
            r = got[(*key, k)]
            assert r["score"] == pytest.approx(s, abs=1e-6) and r["is_train"] == t and r["threshold"] == pytest.approx(limit, abs=1e-6)
            assert r["flag"] == int(not t and r["score"] >= r["threshold"])


def test_no_rows(spark):
    with pytest.raises(ValueError):
        FL.fleet_streams(feed(spark).where("false"), keys=KEYS)
