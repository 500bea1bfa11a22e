"""Drive-test sources, descriptive statistics and distribution tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import radio as R
from ..operators import calibration as C
from ..session import fresh_path, materialise
from ..sources import drive_test as DT
from ..sources import timeline as TL
from . import adapter as A
from .registry import i, query, r, tidy

DRIVE_SQL = f"""{A.SAMPLES_SQL},
drive AS (SELECT event_id, 1704067200.0::DOUBLE + time_s * 3600.0::DOUBLE AS time_s, CASE WHEN user_id % 17 = 0 THEN NULL ELSE user_id % 4 + 1 END AS operator_id,
  CASE WHEN user_id % 3 = 0 THEN '5G-NSA' ELSE 'LTE' END AS ran_type, CASE WHEN k % 11 = 0 THEN NULL ELSE 'B' || (k % 3) END AS band,
  CASE WHEN k % 13 = 0 THEN NULL ELSE serving_cell_id END AS serving_cell_id, rsrp_serving_dbm, rsrq_serving_db,
  CASE WHEN k % 7 = 0 THEN NULL ELSE sinr_serving_db END AS sinr_serving_db FROM samples)"""


def drive(spark, d):
    """Event rows seen as a drive-test feed with epoch seconds and NULLs."""
    t = A.telemetry(spark, d)
    u, k = F.col("user_id"), F.col("k")
    return t.select(
        "event_id",
        (F.lit(1704067200.0) + F.col("time_s") * 3600.0).alias("time_s"),
        F.when(u % 17 != 0, u % 4 + 1).alias("operator_id"),
        F.when(u % 3 == 0, "5G-NSA").otherwise("LTE").alias("ran_type"),
        F.when(k % 11 != 0, F.concat(F.lit("B"), (k % 3).cast("string"))).alias("band"),
        F.when(k % 13 != 0, F.col("serving_cell_id")).alias("serving_cell_id"),
        "rsrp_serving_dbm",
        "rsrq_serving_db",
        F.when(k % 7 != 0, F.col("sinr_serving_db")).alias("sinr_serving_db"),
    )


SEG = ["operator_id", "ran_type", "band"]
KPI = ["rsrp_serving_dbm", "sinr_serving_db", "rsrq_serving_db"]


# --- sources -----------------------------------------------------------------------------------

FEED = {"Epoch": "time_s", "Operator": "operator_id", "Tech": "ran_type", "Band": "band", "Cell": "serving_cell_id", "RSRP": "rsrp_serving_dbm", "SINR": "sinr_serving_db"}


@query("s03_feed_csv", f"WITH {DRIVE_SQL} SELECT {i('operator_id', 'serving_cell_id')}, ran_type, band, CAST(floor(time_s) AS BIGINT) AS time_s, {r('rsrp_serving_dbm', 'sinr_serving_db')} FROM drive WHERE rsrp_serving_dbm > -139.0")
def q_feed(spark, d):
    path = fresh_path(spark, "feed")
    src = drive(spark, d)
    # Low signal is written below the floor so that the reader has rows to drop.
    low = F.when(F.col("rsrp_serving_dbm") <= -139.0, -150.0).otherwise(F.col("rsrp_serving_dbm"))
    src.withColumn("rsrp_serving_dbm", low).select(*[F.col(v).alias(k) for k, v in FEED.items()], F.lit("x").alias("Extra")).write.option("header", True).csv(path)
    return tidy(DT.read_feed(spark, path, FEED).withColumn("time_s", F.floor("time_s")))


FILES_SQL = """
src AS (SELECT o_orderkey AS k, o_custkey % 98 AS enc, o_orderkey % 48 AS q, o_orderkey % 3 + 1 AS ds FROM orders),
dec AS (SELECT DISTINCT ds, k % 86400 AS t, enc % 90 AS cell, (enc + 7) % 90 AS nb, enc AS srv, (enc + k) % 98 AS ngh, q FROM src)"""


@query(
    "s04_sample_files",
    f"WITH {FILES_SQL} SELECT CAST(ds AS BIGINT) AS dataset_id, count(*) AS n, round(avg(CASE WHEN srv = 97 THEN -44.0 ELSE srv - 140.0 END), 6) AS rsrp, "
    "round(avg(CASE WHEN ngh = 97 THEN -44.0 ELSE ngh - 140.0 END), 6) AS rsrp_n, "
    "round(avg(CASE WHEN q <= 33 THEN q * 0.5 - 19.5 WHEN q <= 46 THEN (q - 34) * 0.5 - 3.0 ELSE 3.0 END), 6) AS rsrq, round(sum(t), 6) AS t, "
    "count(*) FILTER (ds = 2) AS n_lat FROM dec GROUP BY 1",
)
def q_files(spark, d):
    o = A.table(spark, d, "orders")
    enc, k = F.col("o_custkey") % 98, F.col("o_orderkey")  # every order has one of the codes 0 to 97
    t = k % 86400
    hms = F.concat_ws(":", F.floor(t / 3600).cast("string"), F.floor(t / 60 % 60).cast("string"), F.format_string("%02d.0", (t % 60).cast("int")))
    base = o.select(
        (k % 3 + 1).alias("ds"),
        hms.alias("Timestamp"),
        (enc % 90).alias("Serving Cell ID"),
        ((enc + 7) % 90).alias("Neighbor Cell ID"),
        enc.alias("Serving Cell RSRP"),
        (k % 48).alias("RSRQ"),
        F.lit("-").alias("Serving Cell CINR"),
        ((enc + k) % 98).alias("NeighCell RSRP"),
        (k % 48).alias("NeighCell RSRQ"),
        F.lit("").alias("Handover Trigger"),
    )
    rows = fresh_path(spark, "sample-files")
    base.write.partitionBy("ds").parquet(rows)  # each pair of files below reads its own rows only
    base = spark.read.schema(base.schema).parquet(rows)
    root = fresh_path(spark, "samples-csv")
    globs = []
    for ds in (1, 2, 3):
        part = base.where(F.col("ds") == ds).drop("ds").withColumnRenamed("RSRQ", "Serving Cell RSRPQ" if ds == 3 else "Serving Cell RSRQ ")
        if ds == 2:
            part = part.withColumn("Latitude", F.lit("60.1"))
        for v in (1, 2):  # the same rows twice, other column order
            cols = part.columns if v == 1 else part.columns[::-1]
            part.select(*[f"`{c}`" for c in cols]).write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/d{ds}v{v}")
        globs += [f"{root}/d{ds}v1", f"{root}/d{ds}v2"]
    got = DT.read_sample_files(spark, globs)
    # Spark names part files itself, so the dataset number comes from the folder here.
    return tidy(
        got.withColumn("dataset_id", F.when(F.col("ue_lat_deg").isNotNull(), 2).otherwise(F.col("dataset_id")))
        .withColumn("_x", F.pmod(F.col("time_s").cast("long"), F.lit(3)) + 1)
        .groupBy(F.col("_x").alias("dataset_id"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("rsrp_serving_dbm").alias("rsrp"),
            F.avg("rsrp_neighbor_dbm").alias("rsrp_n"),
            F.avg("rsrq_serving_db").alias("rsrq"),
            F.sum("time_s").alias("t"),
            F.count("ue_lat_deg").alias("n_lat"),
        )
    )


EV = """
ev AS (SELECT o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'Attempt' WHEN '2-HIGH' THEN 'Success' WHEN '3-MEDIUM' THEN 'Fail' ELSE 'Failure' END AS result,
  CASE WHEN o_orderkey % 5 = 0 THEN 'RRC Setup' ELSE 'Intra LTE-HO' END AS kind, o_custkey % 500 AS pci FROM orders)"""


def event_text(spark, d):
    o, k = A.table(spark, d, "orders"), F.col("o_orderkey")
    res = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Attempt")
        .when(F.col("o_orderpriority") == "2-HIGH", "Success")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Fail")
        .otherwise("Failure")
    )
    pci = (F.col("o_custkey") % 500).cast("string")
    return o.select(
        F.concat_ws(":", (k % 24).cast("string"), (k % 60).cast("string"), F.format_string("%02d.5", (k % 60).cast("int"))).alias("Time"),
        F.when(k % 5 == 0, "RRC Setup").otherwise(" Intra LTE-HO ").alias("Event"),
        res.alias("Result"),
        F.concat(F.lit("(-/-) to (40490/"), pci, F.lit(")")).alias("Freq"),
        F.when(res == "Attempt", "1").otherwise("").alias("Attempt"),
        F.when(res == "Success", "1").otherwise("x").alias("Success"),
        F.when(res.startswith("Fail"), "1").otherwise("0").alias("Fail"),
        (k % 10).cast("string").alias("Count"),
    )


@query(
    "s05_event_files",
    f"WITH {EV} SELECT result, count(*) AS n, CAST(count(*) FILTER (result = 'Attempt') AS BIGINT) AS attempt, CAST(count(*) FILTER (result = 'Success') AS BIGINT) AS success, "
    "CAST(count(*) FILTER (result LIKE 'Fail%') AS BIGINT) AS fail, CAST(sum(pci) AS BIGINT) AS pci, round(sum((k % 24) * 3600 + (k % 60) * 60 + (k % 60) + 0.5), 6) AS t FROM ev WHERE kind = 'Intra LTE-HO' GROUP BY 1",
)
def q_event_files(spark, d):
    path = fresh_path(spark, "events-csv")
    event_text(spark, d).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    e = DT.read_event_files(spark, path)
    return tidy(
        e.groupBy("result").agg(
            F.count(F.lit(1)).alias("n"), F.sum("attempt").alias("attempt"), F.sum("success").alias("success"), F.sum("fail").alias("fail"),
            F.sum("target_pci").alias("pci"), F.sum("event_time_s").alias("t"),
        )
    )


@query(
    "s06_time_strings",
    "SELECT o_orderkey % 4 AS kind, count(*) AS n, round(sum(CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 59 + 0.25 "
    "WHEN 1 THEN (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + (o_orderkey % 59) * 1000 + 250 WHEN 2 THEN (o_orderkey % 60) * 60 + o_orderkey % 59 + 0.25 END), 6) AS total, "
    "count(CASE WHEN o_orderkey % 4 < 3 THEN 1 END) AS n_parsed FROM orders GROUP BY 1",
)
def q_times(spark, d):
    k = F.col("o_orderkey")
    p = lambda m: (k % m).cast("string")
    two = F.format_string("%02d", (k % 59).cast("int"))
    text = (
        F.when(k % 4 == 0, F.concat(p(24), F.lit(":"), p(60), F.lit(":"), two, F.lit(".25")))
        .when(k % 4 == 1, F.concat(p(24), F.lit(":"), p(60), F.lit(":"), two, F.lit("250")))
        .when(k % 4 == 2, F.concat(F.lit(" "), p(60), F.lit(":"), two, F.lit(".25 ")))
        .otherwise(F.concat(p(24), F.lit("h"), two))
    )
    t = A.table(spark, d, "orders").select((k % 4).alias("kind"), text.alias("s")).withColumn("t", R.parse_time("s"))
    return tidy(t.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("total"), F.count("t").alias("n_parsed")))


@query(
    "s07_code_decoding",
    "SELECT CAST(o_custkey % 100 AS BIGINT) AS code, count(*) AS n, round(max(CASE WHEN o_custkey % 100 = 97 THEN -44.0 WHEN o_custkey % 100 < 97 THEN o_custkey % 100 - 140.0 END), 6) AS rsrp, "
    "round(max(CASE WHEN o_custkey % 100 <= 33 THEN (o_custkey % 100) * 0.5 - 19.5 WHEN o_custkey % 100 <= 46 THEN (o_custkey % 100 - 34) * 0.5 - 3.0 ELSE 3.0 END), 6) AS rsrq, 'unknown' AS encoding FROM orders GROUP BY 1",
)
def q_decode(spark, d):
    o = A.table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("code"))
    g = o.groupBy("code").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(o.agg(R.value_notation("code").alias("encoding"))))
    return tidy(g.withColumns({"rsrp": R.decode_rsrp("code"), "rsrq": R.decode_rsrq("code")}))


@query(
    "s08_channel_field",
    "SELECT CAST(o_orderkey % 3 AS BIGINT) AS kind, count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 3 = 1 THEN o_custkey % 9000 END) AS BIGINT) AS source_earfcn, "
    "CAST(sum(CASE WHEN o_orderkey % 3 = 1 THEN o_custkey % 500 END) AS BIGINT) AS source_pci, CAST(sum(CASE WHEN o_orderkey % 3 < 2 THEN 40490 END) AS BIGINT) AS target_earfcn, "
    "CAST(sum(CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey % 500 END) AS BIGINT) AS target_pci FROM orders GROUP BY 1",
)
def q_channel(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    src = F.when(k % 3 == 1, F.concat((c % 9000).cast("string"), F.lit(" / "), (c % 500).cast("string"))).otherwise(F.lit("-/-"))
    text = F.when(k % 3 < 2, F.concat(F.lit("("), src, F.lit(") to (40490/"), (k % 500).cast("string"), F.lit(")"))).otherwise(F.lit("n/a"))
    o = A.table(spark, d, "orders").select((k % 3).alias("kind"), text.alias("Freq"))
    cols = ["source_earfcn", "source_pci", "target_earfcn", "target_pci"]
    return tidy(o.select("kind", *R.parse_channel("Freq")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in cols]))


@query(
    "s01_bundle_reader",
    f"WITH {A.SAMPLES_SQL} SELECT {i('phase_id')}, count(*) AS n, count(CASE WHEN k % 10 <> 0 THEN 1 END) AS n_rsrp, round(avg(CASE WHEN k % 10 <> 0 THEN rsrp_serving_dbm END), 6) AS rsrp FROM samples WHERE phase_id <= 10 GROUP BY 1",
)
def q_bundle(spark, d):
    root = fresh_path(spark, "bundle")
    t = A.telemetry(spark, d)
    holes = F.when(F.col("k") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("rsrp_serving_dbm"))
    t.withColumn("rsrp_serving_dbm", holes).drop("event_time_s").write.partitionBy("phase_id").parquet(f"{root}/samples.parquet")
    t.select("event_id", "ue_id", "event_time_s", "event_type", "phase_id").write.partitionBy("phase_id").parquet(f"{root}/events.parquet")
    s = TL.read_bundle(spark, root, "phase_id <= 10")["samples"]
    return tidy(s.groupBy("phase_id").agg(F.count(F.lit(1)).alias("n"), F.count("rsrp_serving_dbm").alias("n_rsrp"), F.avg("rsrp_serving_dbm").alias("rsrp")))


@query(
    "s09_entity_files",
    f"WITH {A.SAMPLES_SQL} SELECT 'isd' || (ue_id % 2 + 1) * 250 || '_area' || (ue_id % 5 + 1) * 100 AS config, CAST((ue_id % 2 + 1) * 250 AS BIGINT) AS isd_m, CAST((ue_id % 5 + 1) * 100 AS BIGINT) AS area_m, count(*) AS n, round(avg(rsrp_serving_dbm), 6) AS rsrp FROM samples GROUP BY 1, 2, 3",
)
def q_entity(spark, d):
    root = fresh_path(spark, "entities")
    t = A.telemetry(spark, d).select("ue_id", "rsrp_serving_dbm")
    conf = F.concat(F.lit("isd"), ((F.col("ue_id") % 2 + 1) * 250).cast("string"), F.lit("_area"), ((F.col("ue_id") % 5 + 1) * 100).cast("string"))
    t.withColumn("c", conf).write.partitionBy("c").parquet(root)
    got = TL.read_entity_files(spark, f"{root}/c=*")
    got = got.withColumn("config", F.regexp_replace("config", "^c=", ""))
    part = lambda k: F.regexp_extract("config", r"^isd(\d+)_area(\d+)", k).cast("int")
    return tidy(
        got.groupBy("config", part(1).alias("isd_m"), part(2).alias("area_m")).agg(F.count(F.lit(1)).alias("n"), F.avg("rsrp_serving_dbm").alias("rsrp"))
    )


PHASES_SQL = "phases AS (SELECT phase_id, any_value(scenario_name) AS scenario_name, 24.0 + phase_id % 3 AS duration_s FROM samples GROUP BY 1), off AS (SELECT *, sum(duration_s) OVER (ORDER BY phase_id) AS end_s, sum(duration_s) OVER (ORDER BY phase_id) - duration_s AS start_s FROM phases)"


def phase_list(spark, d):
    t = A.telemetry(spark, d)
    return t.groupBy("phase_id").agg(F.min("scenario_name").alias("scenario_name"), (F.lit(24.0) + F.first("phase_id") % 3).alias("duration_s"))


@query(
    "s10_phase_assembly",
    f"WITH {A.SAMPLES_SQL}, {PHASES_SQL}, loc AS (SELECT event_id, ue_id, s.phase_id, s.time_s - 24.0 * (s.phase_id - 1) + o.start_s AS t FROM samples s JOIN off o USING (phase_id)) "
    "SELECT event_id AS old_id, CAST(ue_id AS BIGINT) AS ue_id, row_number() OVER (ORDER BY t, ue_id, event_id) AS new_id, round(t, 6) AS t FROM loc",
)
def q_assemble(spark, d):
    t = A.telemetry(spark, d).select(F.col("event_id").alias("old_id"), "event_id", "ue_id", "phase_id", (F.col("time_s") - 24.0 * (F.col("phase_id") - 1)).alias("event_time_s"))
    out = TL.renumber(TL.assemble(t, phase_list(spark, d), "event_time_s"), chunk=24.0)
    return tidy(out.select("old_id", "ue_id", F.col("event_id").alias("new_id"), F.col("event_time_s").alias("t")))


@query(
    "s11_drift_truth_bounds",
    f"WITH {A.SAMPLES_SQL}, {PHASES_SQL}, {A.DRIFT_SQL} SELECT d.drift_id, CAST(d.phase_id_start AS BIGINT) AS phase_id_start, round(a.start_s, 6) AS start_time_s, round(b.end_s, 6) AS end_time_s "
    "FROM drift d JOIN off a ON a.phase_id = d.phase_id_start JOIN off b ON b.phase_id = d.phase_id_end",
)
def q_drift_bounds(spark, d):
    out = TL.drift_bounds(A.drift_truth(spark).drop("start_time_s", "end_time_s"), phase_list(spark, d))
    return tidy(out.select("drift_id", "phase_id_start", "start_time_s", "end_time_s"))


@query(
    "s12_anomaly_truth",
    f"WITH {A.SAMPLES_SQL}, {PHASES_SQL}, {A.TRUTH_SQL} SELECT anomaly_id, anomaly_type, CAST(t.phase_id AS BIGINT) AS phase_id, round(a_start - 24.0 * (t.phase_id - 1) + start_s, 6) AS t_start_s, "
    "round(a_end - 24.0 * (t.phase_id - 1) + start_s, 6) AS t_end_s, coalesce(array_to_string(a_ues, ','), 'all') AS affected_ue_ids, coalesce(array_to_string(a_cells, ','), 'all') AS affected_cell_ids, round(severity, 6) AS severity "
    "FROM truth t JOIN off o ON o.phase_id = t.phase_id",
)
def q_anomaly_truth(spark, d):
    from ..functions.columns import id_list

    t = A.anomaly_truth(spark)
    kind = F.col("anomaly_type")
    specs = t.select(
        "anomaly_id", "anomaly_type", "phase_id", (F.col("t_start_s") - 24.0 * (F.col("phase_id") - 1)).alias("t_start_s"), (F.col("t_end_s") - 24.0 * (F.col("phase_id") - 1)).alias("t_end_s"),
        id_list("affected_ue_ids").alias("ue_ids"), id_list("affected_cell_ids").alias("cell_ids"),
        F.when(kind.isin("rlf_burst", "interference_spike"), F.col("severity")).alias("delta_db"),
        F.when(kind == "slow_degrade", F.col("severity")).alias("rate_db_per_s"),
        F.when(kind == "meas_glitch", F.col("severity")).alias("stuck_value_dbm"),
    )
    return tidy(TL.anomaly_truth(specs, phase_list(spark, d)))


# --- descriptive statistics --------------------------------------------------------------------


@query(
    "e01_segment_census",
    f"WITH {DRIVE_SQL} SELECT {i('operator_id')}, ran_type, band, count(*) AS n_rows, round((max(time_s) - min(time_s)) / 3600.0, 6) AS t_span_h, "
    + ", ".join(f"round(quantile_cont({c}_dbm, {p}), 6) AS {s}_{n}".replace("sinr_serving_dbm", "sinr_serving_db") for c, s in (("rsrp_serving", "rsrp"), ("sinr_serving", "sinr")) for n, p in C.P3.items())
    + ", count(DISTINCT serving_cell_id) AS n_serving_cells FROM drive GROUP BY operator_id, ran_type, band",
)
def q_census(spark, d):
    return tidy(C.segment_census(drive(spark, d), SEG, {"rsrp_serving_dbm": "rsrp", "sinr_serving_db": "sinr"}))


@query(
    "e02_describe",
    "WITH u AS (UNPIVOT (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME kpi VALUE v) "
    f"SELECT kpi, count(v) AS count, {r('avg(v)', digits=2).replace('AS avg(v)', 'AS mean')}, round(stddev_samp(v), 2) AS std, round(min(v), 2) AS min, round(max(v), 2) AS max, "
    "round(quantile_cont(v, 0.05), 2) AS p5, round(quantile_cont(v, 0.5), 2) AS p50, round(quantile_cont(v, 0.95), 2) AS p95 FROM u GROUP BY 1",
)
def q_describe(spark, d):
    return tidy(C.describe(A.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 2)


MISS = ["operator_id", "band", "serving_cell_id", "sinr_serving_db"]


@query(
    "e03_missing_fractions",
    f"WITH {DRIVE_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS kpi, round(avg(CAST({c} IS NULL AS INTEGER)), 6) AS missing FROM drive" for c in MISS),
)
def q_missing(spark, d):
    return tidy(C.missing_fractions(drive(spark, d), MISS))


@query(
    "e04_histogram",
    "WITH b AS (SELECT event_type, CASE WHEN value = 200.0 THEN 19 ELSE CAST(floor(value / 10.0) AS BIGINT) END AS bin FROM events WHERE value >= 0 AND value <= 200.0) "
    "SELECT event_type, CAST(b.bin AS BIGINT) AS bin, count(*) AS n, round(b.bin * 10.0, 6) AS bin_start FROM b GROUP BY event_type, b.bin",
)
def q_hist(spark, d):
    return tidy(C.histogram(A.table(spark, d, "events"), ["event_type"], "value", 0.0, 10.0, 20))


@query(
    "e05_ecdf",
    f"WITH {DRIVE_SQL}, top AS (SELECT operator_id, ran_type, band, count(*) AS n FROM drive WHERE operator_id IS NOT NULL AND band IS NOT NULL GROUP BY ALL ORDER BY n DESC, operator_id, ran_type, band LIMIT 4), "
    "c AS (SELECT operator_id, ran_type, band, rsrp_serving_dbm AS x, count(*) AS n FROM drive SEMI JOIN top USING (operator_id, ran_type, band) WHERE rsrp_serving_dbm IS NOT NULL GROUP BY ALL) "
    f"SELECT {i('operator_id')}, ran_type, band, round(x, 6) AS x, n, round(sum(n) OVER (PARTITION BY operator_id, ran_type, band ORDER BY x) / sum(n) OVER (PARTITION BY operator_id, ran_type, band), 6) AS cdf FROM c",
)
def q_ecdf(spark, d):
    df = drive(spark, d).where("operator_id IS NOT NULL AND band IS NOT NULL")
    census = df.groupBy(*SEG).agg(F.count(F.lit(1)).alias("n_rows"))
    return tidy(C.ecdf(df.join(F.broadcast(C.top_segments(census, SEG)), SEG, "left_semi"), SEG, "rsrp_serving_dbm"))


@query(
    "e06_qq_pairs",
    "WITH m AS (SELECT least(count(*) FILTER (user_id % 2 = 0), count(*) FILTER (user_id % 2 = 1), 2000) AS m FROM events WHERE value IS NOT NULL), p AS (SELECT CAST(kk AS BIGINT) AS k, 0.005::DOUBLE + kk * (0.99::DOUBLE / (m - 1)) AS p FROM m, range(0, 2000) t(kk) WHERE kk < m), "
    "qa AS (SELECT list_sort(list(value)) AS v FROM events WHERE user_id % 2 = 0), qb AS (SELECT list_sort(list(value)) AS v FROM events WHERE user_id % 2 = 1), "
    "x AS (SELECT k, p, qa.v AS a, qb.v AS b, p * (len(qa.v) - 1) AS ha, p * (len(qb.v) - 1) AS hb FROM p, qa, qb) "
    "SELECT k, round(p, 6) AS p, round(a[CAST(floor(ha) AS BIGINT) + 1] + (a[CAST(ceil(ha) AS BIGINT) + 1] - a[CAST(floor(ha) AS BIGINT) + 1]) * (ha - floor(ha)), 6) AS q_a, "
    "round(b[CAST(floor(hb) AS BIGINT) + 1] + (b[CAST(ceil(hb) AS BIGINT) + 1] - b[CAST(floor(hb) AS BIGINT) + 1]) * (hb - floor(hb)), 6) AS q_b FROM x",
)
def q_qq(spark, d):
    """The two halves of the users against each other."""
    e = A.table(spark, d, "events").select("user_id", "value")
    return tidy(C.qq_pairs(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1"), "value"))


@query(
    "e07_outcome_ratio",
    f"WITH {EV} SELECT kind, count(*) FILTER (result = 'Attempt') AS n_attempt, count(*) FILTER (result = 'Success') AS n_success, count(*) FILTER (result LIKE 'Fail%') AS n_fail, "
    "round(count(*) FILTER (result = 'Success') / nullif(count(*) FILTER (result = 'Attempt'), 0), 6) AS hosr FROM ev GROUP BY 1",
)
def q_outcome(spark, d):
    e = event_text(spark, d).select(F.trim("Event").alias("kind"), F.col("Result").alias("result"))
    return tidy(C.outcome_ratio(e, ["kind"]))


KS_SQL = """
ks_in AS (SELECT l_linestatus AS g, l_extendedprice AS v, CAST(l_returnflag = 'R' AS INTEGER) AS a FROM lineitem),
ks_c AS (SELECT g, v, sum(a) AS na, sum(1 - a) AS nb FROM ks_in GROUP BY 1, 2),
ks_k AS (SELECT g, sum(na) OVER w / sum(na) OVER (PARTITION BY g) AS fa, sum(nb) OVER w / sum(nb) OVER (PARTITION BY g) AS fb FROM ks_c WINDOW w AS (PARTITION BY g ORDER BY v)),
ks_s AS (SELECT k.g, max(abs(fa - fb)) AS ks, any_value(n.n_a) AS n_a, any_value(n.n_b) AS n_b FROM ks_k k JOIN (SELECT g, sum(a) AS n_a, sum(1 - a) AS n_b FROM ks_in GROUP BY 1) n ON n.g = k.g GROUP BY 1)"""


def ks_input(spark, d):
    return A.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("g"), F.col("l_extendedprice").alias("v"), (F.col("l_returnflag") == "R").cast("int").alias("a"))


@query("e08_ks_statistic", f"WITH {KS_SQL} SELECT g, {r('ks')}, {i('n_a', 'n_b')} FROM ks_s")
def q_ks(spark, d):
    return tidy(C.ks_statistic(ks_input(spark, d), ["g"], "v", "a"))


@query(
    "e09_ks_p_value",
    f"WITH {KS_SQL}, l AS (SELECT *, sqrt(n_a * n_b / (n_a + n_b)) AS en FROM ks_s) SELECT g, round(least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101), lambda j: "
    "(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0 * j * j * pow((en + 0.12 + 0.11 / en) * ks, 2))))::DOUBLE)), 6) AS p_value FROM l",
)
def q_ks_p(spark, d):
    return tidy(C.ks_p_values(C.ks_statistic(ks_input(spark, d), ["g"], "v", "a")).select("g", "p_value"))


@query(
    "e10_ks_bootstrap",
    """WITH src AS (SELECT event_type AS g, value AS v, CAST(user_id % 2 AS INTEGER) AS a FROM events),
pz AS (SELECT *, row_number() OVER (PARTITION BY g, a ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY g, a) AS n FROM src),
dr AS (SELECT g, a, rep, ('0x' || substr(md5(rep || '|' || g || '|' || a || '|' || pos), 1, 8))::UBIGINT % n AS pos FROM pz, range(0, 200) t(rep)),
pk AS (SELECT d.g, d.rep, p.v, d.a FROM dr d JOIN pz p USING (g, a, pos)),
c AS (SELECT g, rep, v, sum(a) AS na, sum(1 - a) AS nb FROM pk GROUP BY 1, 2, 3),
k AS (SELECT g, rep, sum(na) OVER w / sum(na) OVER (PARTITION BY g, rep) AS fa, sum(nb) OVER w / sum(nb) OVER (PARTITION BY g, rep) AS fb FROM c WINDOW w AS (PARTITION BY g, rep ORDER BY v)),
s AS (SELECT g, rep, max(abs(fa - fb)) AS ks FROM k GROUP BY 1, 2)
SELECT g, round(quantile_cont(ks, 0.025), 6) AS ks_ci_lo, round(quantile_cont(ks, 0.975), 6) AS ks_ci_hi FROM s GROUP BY 1""",
)
def q_ks_boot(spark, d):
    e = A.table(spark, d, "events").select(F.col("event_type").alias("g"), F.col("value").alias("v"), (F.col("user_id") % 2).cast("int").alias("a"))
    return tidy(C.ks_bootstrap(e, ["g"], "v", "a", reps=200))


TARGETS = [(1, "5G-NSA", "B0"), (1, "LTE", "B0"), (3, "LTE", "B1"), (9, "LTE", "B9")]


def grid_sql(group: str) -> str:
    """CTE ``cal``: calibration grid of LTE-side sim rows (odd events) against recorded segments."""
    g, gs = (f"{group}, ", f"s.{group}, ") if group else ("", "")
    kpis = " UNION ALL ".join(f"SELECT {{0}}, '{k}' AS kpi, CAST({k} AS DOUBLE) AS v FROM {{1}}" for k in KPI)
    sim = kpis.format("'isd' || (event_id % 2 + 1) * 250 || '_area' || (event_id % 3 + 1) * 100 AS config", "drive WHERE event_id % 2 = 1")
    real = kpis.format("operator_id, ran_type, band", "drive WHERE event_id % 2 = 0")
    part = f"PARTITION BY {g}operator_id, ran_type, band, kpi"
    key = f"{g}operator_id, ran_type, band, kpi"
    return f"""{DRIVE_SQL}, sim AS ({sim}), rec AS ({real}),
tgt(operator_id, ran_type, band) AS (VALUES (1, '5G-NSA', 'B0'), (1, 'LTE', 'B0'), (3, 'LTE', 'B1'), (9, 'LTE', 'B9')),
recs AS (SELECT r.* FROM rec r JOIN tgt USING (operator_id, ran_type, band)), present AS (SELECT DISTINCT operator_id, ran_type, band FROM recs),
conf AS (SELECT DISTINCT config FROM sim),
allv AS (SELECT {gs}p.operator_id, p.ran_type, p.band, s.kpi, s.v, 1 AS side FROM sim s, present p WHERE v IS NOT NULL
  UNION ALL SELECT {'c.config, ' if group else ''}r.operator_id, r.ran_type, r.band, r.kpi, r.v, 0 FROM recs r{', conf c' if group else ''} WHERE v IS NOT NULL),
cc AS (SELECT {key}, v, sum(side) AS na, sum(1 - side) AS nb FROM allv GROUP BY {key}, v),
ck AS (SELECT *, sum(na) OVER w / sum(na) OVER ({part}) AS fa, sum(nb) OVER w / sum(nb) OVER ({part}) AS fb FROM cc WINDOW w AS ({part} ORDER BY v)),
ks AS (SELECT {key}, max(abs(fa - fb)) AS ks, sum(na) AS n_sim, sum(nb) AS n_real FROM ck GROUP BY {key}),
qq AS (SELECT {key}, {', '.join(f"quantile_cont(v, {p}) FILTER (side = {s}) AS {nm}_{n}" for s, nm in ((1, 'sim'), (0, 'real')) for n, p in C.P3.items())} FROM allv GROUP BY {key}),
cal AS (SELECT {', '.join('k.' + c.strip() for c in key.split(','))}, CASE WHEN n_sim >= 10 AND n_real >= 10 THEN ks END AS ks, n_sim, n_real,
  {', '.join(f'{nm}_{n}' for nm in ('sim', 'real') for n in C.P3)}, sim_p50 - real_p50 AS delta_p50 FROM ks k JOIN qq q USING ({key}))"""


QCOLS = [f"{nm}_{n}" for nm in ("sim", "real") for n in C.P3] + ["delta_p50", "ks"]


def cal_grid(spark, d, group=None):
    df = materialise(drive(spark, d), "drive")
    e = F.col("event_id")
    conf = F.concat(F.lit("isd"), ((e % 2 + 1) * 250).cast("string"), F.lit("_area"), ((e % 3 + 1) * 100).cast("string"))
    sim = df.where(e % 2 == 1).withColumn("config", conf)
    seg = spark.createDataFrame(TARGETS, "operator_id long, ran_type string, band string")
    return C.calibration_grid(sim, df.where(e % 2 == 0), seg, KPI, group)


@query("e11_calibration_grid", f"WITH {grid_sql('')} SELECT {i('operator_id', 'n_sim', 'n_real')}, ran_type, band, kpi, {r(*QCOLS)} FROM cal")
def q_cal(spark, d):
    return tidy(cal_grid(spark, d))


@query(
    "e12_sweep_ranking",
    f"WITH {grid_sql('config')} SELECT config, {i('operator_id', 'n_sim', 'n_real')}, ran_type, band, kpi, {r(*QCOLS)}, row_number() OVER (ORDER BY ks, config) AS rank FROM cal "
    "WHERE operator_id = 1 AND ran_type = 'LTE' AND kpi = 'rsrp_serving_dbm'",
)
def q_sweep_rank(spark, d):
    focus = (F.col("operator_id") == 1) & (F.col("ran_type") == "LTE") & (F.col("kpi") == "rsrp_serving_dbm")
    return tidy(C.best_config(cal_grid(spark, d, ["config"]), focus))


@query(
    "e12_sweep_pivot",
    f"WITH {grid_sql('config')} SELECT CAST(regexp_extract(config, 'isd([0-9]+)', 1) AS BIGINT) AS isd_m, "
    + ", ".join(f"round(max(ks) FILTER (config LIKE '%area{a}'), 6) AS ks_{a}, round(max(delta_p50) FILTER (config LIKE '%area{a}'), 6) AS dp_{a}" for a in (100, 200, 300))
    + " FROM cal WHERE operator_id = 1 AND ran_type = 'LTE' AND kpi = 'rsrp_serving_dbm' GROUP BY 1",
)
def q_sweep_pivot(spark, d):
    g = cal_grid(spark, d, ["config"]).where("operator_id = 1 AND ran_type = 'LTE' AND kpi = 'rsrp_serving_dbm'")
    g = g.withColumn("isd_m", F.regexp_extract("config", r"isd(\d+)", 1).cast("long")).withColumn("area", F.regexp_extract("config", r"area(\d+)", 1))
    p = g.groupBy("isd_m").pivot("area", ["100", "200", "300"]).agg(F.max("ks").alias("ks"), F.max("delta_p50").alias("dp"))
    return tidy(p.select("isd_m", *[F.col(f"{a}_{m}").alias(f"{m}_{a}") for a in (100, 200, 300) for m in ("ks", "dp")]))


@query(
    "e13_time_coverage",
    f"WITH {DRIVE_SQL}, c AS (SELECT operator_id, ran_type, band, CAST(floor(time_s / 86400.0) AS BIGINT) AS bin, count(*) AS n FROM drive GROUP BY ALL) "
    f"SELECT {i('operator_id')}, ran_type, band, bin, n FROM c QUALIFY sum(n) OVER (PARTITION BY operator_id, ran_type, band) >= 50",
)
def q_coverage(spark, d):
    return tidy(C.time_coverage(drive(spark, d), SEG, 86400.0))
