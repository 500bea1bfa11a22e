import numpy as np
import pandas as pd
import pytest

from wavegauge.operators import control as C


@pytest.mark.parametrize("chunk", [4.0, 1e6])
def test_smoothing_matches_recurrence(spark, chunk):
    rng = np.random.default_rng(0)
    rows = []
    for u in range(3):
        for t in range(60):
            rows.append((u, float(t), None if rng.random() < 0.3 or (u == 1 and t < 9) else float(rng.normal())))
    d = spark.createDataFrame(rows, "ue_id long, time_s double, v double")
    got = C.smooth(d, ["ue_id"], "time_s", "v", 0.4, chunk).toPandas().sort_values(["ue_id", "time_s"])
    for u, g in got.groupby("ue_id"):
        f, want = None, []
        for v in g["v"]:
            if not pd.isna(v):
                f = v if f is None else 0.6 * f + 0.4 * v
            want.append(f)
        assert np.allclose(g["smoothed"].astype(float), np.array(want, float), equal_nan=True)


def test_a3_needs_unbroken_run(spark):
    # Cell 2 qualifies at ticks 0-1 and 3-6; cell 3 at 3-6 as well.
    level = {2: [-70, -70, -95, -70, -70, -70, -70], 3: [-95, -95, -95, -70, -70, -70, -70]}
    rows = [(1, float(t), c, float(v), -90.0) for c, vs in level.items() for t, v in enumerate(vs)]
    d = spark.createDataFrame(rows, "ue_id long, time_s double, cell_id int, rsrp_dbm double, serving_dbm double")
    got = C.a3_entries(d, 2.0, 0.0, ttt=3.0, dt=1.0, chunk=2.0).collect()
    assert [(r["time_s"], r["target_cell_id"]) for r in got] == [(5.0, 2)]


def test_ping_pong_window(spark):
    rows = [(1, 1, 0.0, 1, 2), (2, 1, 3.0, 2, 1), (3, 1, 9.0, 1, 2), (4, 2, 1.0, 5, 6)]
    d = spark.createDataFrame(rows, "event_id long, ue_id long, event_time_s double, source_cell_id int, target_cell_id int")
    assert [r["event_id"] for r in C.ping_pongs(d, 5.0, chunk=2.0).collect()] == [2]


def test_outcomes(spark):
    a = spark.createDataFrame([(1, 1, 10.0, 7), (2, 1, 20.0, 8)], "event_id long, ue_id long, event_time_s double, target_cell_id int")
    f = spark.createDataFrame([(1, 10.04)], "ue_id long, time_s double")
    b = spark.createDataFrame([(1, 9.0, 3), (1, 10.04, 4)], "ue_id long, time_s double, serving_cell_id int")
    got = {r["event_id"]: (r["outcome"], r["outcome_time_s"], r["cell_after"]) for r in C.handover_outcomes(a, f, 0.05, b).collect()}
    assert got[1] == ("fail", 10.04, 4) and got[2] == ("success", 20.05, 8)


def test_fault_rules(spark):
    meas = spark.createDataFrame([(1, float(t), 3, -90.0 - t, -10.0, 5.0) for t in range(6)] + [(2, 1.0, 4, -80.0, -10.0, 5.0)], "ue_id long, time_s double, cell_id int, rsrp_dbm double, rsrq_db double, sinr_db double")
    specs = spark.createDataFrame(
        [
            (1, "rlf_burst", 1.0, 3.0, [1], None, -10.0, None, None),
            (2, "meas_glitch", 2.0, 5.0, [1], None, None, None, None),
            (3, "slow_degrade", 0.0, 6.0, None, None, None, -1.0, None),
            (4, "interference_spike", 0.0, 9.0, None, [4], -4.0, None, None),
        ],
        f"ord int, {C.FAULT_FIELDS}",
    )
    got = {(r["ue_id"], r["time_s"]): r for r in C.inject_faults(meas, specs).collect()}
    assert got[1, 1.0]["sinr_db"] == 5 - 10 - 1 and got[1, 1.0]["rsrq_db"] == -15.0
    assert got[1, 3.0]["sinr_db"] == 5 - 3 and [got[1, float(t)]["rsrp_dbm"] for t in range(6)] == [-90, -91, -92, -92, -92, -95]
    assert got[2, 1.0]["sinr_db"] == 5 - 4 - 1 and got[2, 1.0]["rsrq_db"] == -12.0
