import duckdb
import pytest
from oracle import compare, duck

import __spark_entry__ as entry

# A cross-section of the registered queries; the full set runs through tests/oracle.py.
SMALL = [
    "f01_window_features", "l02_window_labels", "m01_average_precision", "m03_bootstrap_ap_plain", "r06_streams_long", "r18_detection_latency",
    "e01_segment_census", "e08_ks_statistic", "t02_l3_smoothing", "t10_fault_injection", "i05_interventions", "x09_metric_deltas", "u03_rolling_rates",
]


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) > 130


def test_oracles_parse():
    con = duckdb.connect()
    for name, sql in entry.oracle_sql().items():
        assert con.extract_statements(sql), name


@pytest.mark.parametrize("name", SMALL)
def test_query_matches_sql(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = duck(sf).execute(entry.oracle_sql()[name]).fetchdf()
    assert compare(got, want) == ""


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "rsrp_serving_dbm__p50" in df.columns


def test_names_are_known_without_a_session():
    import pathlib
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parents[1]
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_drift_phase_ap_covers_the_quiet_phases(spark, sf):
    """Phases 4 and 9, which hold anomalies and no drift, count besides the drift phases."""
    from wavegauge.plans import adapter as A
    from wavegauge.plans.window_queries import scored

    got = entry.queries()["m14_drift_phase_ap"](spark, sf).toPandas()
    assert compare(got, duck(sf).execute(entry.oracle_sql()["m14_drift_phase_ap"]).fetchdf()) == ""
    phases = [*A.SCENARIOS, 4, 9]
    want = {r["detector"]: r["count"] for r in scored(spark, sf).where("score IS NOT NULL").where(f"phase_id IN ({', '.join(map(str, phases))})").groupBy("detector").count().collect()}
    assert dict(zip(got["detector"], got["n_pos"] + got["n_neg"])) == want
