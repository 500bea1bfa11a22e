import gzip
import hashlib
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavegauge.functions import radio as R
from wavegauge.operators import drift as D
from wavegauge.plans import adapter as A
from wavegauge.plans import live_queries as LQ
from wavegauge.plans import validation_queries as VQ
from wavegauge.sources import artefacts as S
from wavegauge.sources import drive_test as DT
from wavegauge.sources import timeline as T
from wavegauge.sources.digests import sha256_in_pieces
from wavegauge.streaming import live as U


def test_time_notations(spark):
    cases = {"33:33.7": 2013.7, " 16:47:14.242 ": 60434.242, "1:02:03": 3723.0, "abc": None, "": None, "12": None}
    d = spark.createDataFrame([(c,) for c in cases], "s string").select("s", R.parse_time("s").alias("t"))
    for r in d.collect():
        want = cases[r["s"]]
        assert r["t"] == want if want is None else np.isclose(r["t"], want)


def test_codes_and_channels(spark):
    d = spark.createDataFrame([(0,), (96,), (97,), (98,), (-1,)], "c int").select("c", R.decode_rsrp("c").alias("p"), R.decode_rsrq("c").alias("q"))
    assert [(r["p"], r["q"]) for r in d.collect()] == [(-140.0, -19.5), (-44.0, 3.0), (-44.0, 3.0), (None, 3.0), (None, None)]
    f = spark.createDataFrame([("(-/-) to (40490/259)",), ("(1/2) to (3/4)",), ("x",), (None,)], "f string").select(*R.parse_channel("f"))
    assert [tuple(r) for r in f.collect()] == [(None, None, 40490, 259), (1, 2, 3, 4), (None,) * 4, (None,) * 4]


def test_sample_files_variants(spark, tmp_path):
    head = "Timestamp,Serving Cell ID ,Neighbor Cell ID,Serving Cell RSRP,{q},Serving Cell CINR,NeighCell RSRP,NeighCell RSRQ,Handover Trigger"
    (tmp_path / "Dataset_1_ver_1.csv").write_text(head.format(q="Serving Cell RSRQ") + "\n33:33.7,1,2,50,20,3,--,10,\n")
    (tmp_path / "Dataset_1_ver_2.csv").write_text(head.format(q="Serving Cell RSRPQ") + ",Latitude\n33:33.7,1,2,50,20,3,--,10,1,60.5\n34:00,1,2,40,20,3,30,10,1,60.5\n")
    got = DT.read_sample_files(spark, [str(tmp_path / "Dataset_1_ver_1.csv"), str(tmp_path / "Dataset_1_ver_2.csv")]).orderBy("time_s").collect()
    assert len(got) == 2 and got[0]["rsrp_serving_dbm"] == -90.0 and got[0]["rsrp_neighbor_dbm"] is None and got[1]["dataset_id"] == 1
    (tmp_path / "bad.csv").write_text("Timestamp\n1:1\n")
    with pytest.raises(ValueError):
        DT.read_sample_files(spark, [str(tmp_path / "bad.csv")])


def test_bundle_contract(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        T.read_bundle(spark, str(tmp_path / "none"))


def test_fingerprints(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "b.csv").write_text("2")
    files = S.fingerprint(spark, [str(tmp_path)], [".csv"], ["skip"])
    r = files.first()
    assert files.count() == 1 and r["sha256"] == hashlib.sha256(b"1").hexdigest() and r["size"] == 1
    m = spark.createDataFrame([(r["path"], r["sha256"]), ("gone", "x")], "path string, sha256 string")
    assert {x["status"] for x in S.verify(m, files).collect()} == {"OK", "MISSING"}
    assert S.verify(m.withColumn("sha256", F.lit("0")), files).where("status = 'MISMATCH'").count() == 1


def test_fingerprints_of_long_files(spark, tmp_path):
    """Files beyond the limit of Spark's reader of whole files give the same digests, read in pieces; only packed ones are read whole."""
    rng = np.random.default_rng(5)
    noise = lambda n: rng.integers(0, 256, n, dtype=np.uint8).tobytes()
    texts = {
        "noise": noise(9999), "feeds": b"\n" * 4000, "no_feed": b"x" * 4000, "mark": b"\xef\xbb\xbf" + noise(3000) + b"\n", "returns": b"a\r\nb\r" * 700,
        "edges": (b"y" * 999 + b"\n") * 4, "begins": (b"\n" + b"y" * 999) * 4, "a [b]{c}*?": noise(3000), "short": b"z",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.bin").write_bytes(text)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        got = S.fingerprint(spark, [str(tmp_path)], whole=1000, piece=1000).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert {r["path"].rsplit("/", 1)[1]: (r["size"], r["sha256"]) for r in got} == {f"{n}.bin": (len(t), hashlib.sha256(t).hexdigest()) for n, t in texts.items()}
    packed = gzip.compress(noise(3000))
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "a.gz").write_bytes(packed)
    assert S.fingerprint(spark, [str(tmp_path / "only")], whole=1000, piece=1000).first()["sha256"] == hashlib.sha256(packed).hexdigest()
    with pytest.raises(ValueError):
        sha256_in_pieces(spark, str(tmp_path / "noise.bin"), 9000, 1000)


def test_fingerprint_query_reads_files_once(spark, sf):
    out = VQ.q_fingerprints(spark, sf)
    assert "binaryFile" not in out._jdf.queryExecution().toString()
    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in pathlib.Path(sf).glob("*.parquet")}
    rows = out.collect()
    assert {r["file"]: (r["size"], r["sha256"]) for r in rows} == want
    assert {r["file"]: r["status"] for r in rows} == {n: "MISMATCH" if n == "region.parquet" else "OK" for n in want}


def test_live_detectors_equal_batch(spark, sf):
    live = LQ.q_live(spark, sf).toPandas()
    t = A.telemetry(spark, sf).select(F.col("event_type").alias("stream_name"), "time_s", F.col("rsrp_serving_dbm").alias("value"))
    batch = D.run_sequential(t).toPandas()
    key = lambda d: sorted(zip(d.stream_name, d.detector, d.time_s.round(6)))
    assert key(live) == key(batch)


def test_live_state_spans_batches(spark, sf, tmp_path):
    t = A.telemetry(spark, sf).select(F.col("event_type").alias("stream_name"), "time_s", F.col("rsrp_serving_dbm").alias("value")).orderBy("time_s")
    rows = t.collect()
    for k in range(4):  # four files in time order, one per batch
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        spark.createDataFrame(part, t.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = U.file_stream(spark, str(tmp_path / "in"), t.schema, files_per_batch=1)
    live = U.run_available(U.live_detectors(s, ["ADWIN", "PageHinkley"])).count()
    names = {n: D.D.SEQUENTIAL[n] for n in ("ADWIN", "PageHinkley")}
    assert live == D.run_sequential(t, names).count()


def test_update_mode_keeps_the_latest_row_of_every_batch(spark, tmp_path):
    for i, rows in enumerate(([(1, 1.0), (2, 1.0)], [(1, 2.0)], [(3, 5.0), (1, 1.0)])):
        spark.createDataFrame(rows, "k long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = U.file_stream(spark, str(tmp_path / "in/*"), "k long, v double", files_per_batch=1).groupBy("k").agg(F.sum("v").alias("s"))
    got = U.run_available(stream, "update", keys=["k"]).collect()
    assert sorted((r["k"], r["s"]) for r in got) == [(1, 4.0), (2, 1.0), (3, 5.0)]
    with pytest.raises(ValueError):
        U.run_available(stream, "update")
    (tmp_path / "none").mkdir()
    empty = U.file_stream(spark, str(tmp_path / "none"), "k long, v double").groupBy("k").agg(F.sum("v").alias("s"))
    assert U.run_available(empty, "complete").count() == 0


def test_sample_event_join_by_slots(spark):
    """Every pair within the span, also across slot borders and before 1970; rows meet by ue and slot, not by ue alone."""
    times = [-3600, -1801, -1800, -1, 0, 1, 1799, 1800, 1801, 3599, 3600, 3601]
    s = spark.createDataFrame([(u, i, t, -90.0, "RLF") for u in (1, 2) for i, t in enumerate(times)], "ue_id long, event_id long, t long, rsrp_serving_dbm double, event_type string")
    s = s.withColumn("ts", F.timestamp_seconds("t"))
    joined = U.join_samples_events(s, s, "30 MINUTES")
    want = sorted((u, e, i) for u in (1, 2) for e, a in enumerate(times) for i, b in enumerate(times) if a - 1800 <= b <= a)
    assert sorted((r["ue_id"], r["event_id"], r["sample_id"]) for r in joined.collect()) == want
    keys = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_ss" in keys and "_es" in keys


def test_sample_event_stream_keeps_blocks_and_not_pairs(spark, tmp_path):
    """What the stream writes grows with the rows; the pairs, as many as in a plain join, are made on reading."""
    s = spark.range(600).selectExpr("id % 2 AS ue_id", "id AS event_id", "timestamp_seconds(id * 5 + 5) AS ts", "-id / 2D AS rsrp_serving_dbm", "'RLF' AS event_type")
    s.union(s.selectExpr("NULL", "event_id", "ts", "rsrp_serving_dbm", "event_type").limit(3)).write.parquet(str(tmp_path / "rows"))
    stream = lambda: U.file_stream(spark, str(tmp_path / "rows"), s.schema)
    blocks = U.run_available(U.sample_event_blocks(stream(), stream(), "30 MINUTES", "1 hour"))
    assert blocks.count() < 100
    got = U.sample_event_pairs(blocks, "30 MINUTES")
    want = [(e, i, e % 2, "RLF", -i / 2) for e in range(600) for i in range(e % 2, e + 1, 2) if (e - i) * 5 <= 1800]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 50_000
