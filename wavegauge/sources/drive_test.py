"""Readers for drive-test CSV feeds and event statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, require_columns
from ..functions.radio import decode_rsrp, decode_rsrq, parse_channel, parse_time, value_notation

# Fixed header names of the sample files, with accepted spellings.
SAMPLE_HEADERS = {
    "timestamp": ["Timestamp"],
    "serving_cell_id": ["Serving Cell ID"],
    "neighbor_cell_id": ["Neighbor Cell ID"],
    "rsrp_serving": ["Serving Cell RSRP"],
    "rsrq_serving": ["Serving Cell RSRQ", "Serving Cell RSRPQ"],
    "cinr_serving": ["Serving Cell CINR"],
    "rsrp_neighbor": ["NeighCell RSRP"],
    "rsrq_neighbor": ["NeighCell RSRQ"],
    "handover_trigger": ["Handover Trigger"],
}
OPTIONAL_HEADERS = {"ue_lat_deg": ["Latitude"], "ue_lon_deg": ["Longitude"], "ue_speed_kmh": ["Speed (km/h)"]}


def read_feed(spark: SparkSession, path: str, rename: dict[str, str], drop_no_signal: bool = True) -> DataFrame:
    """One CSV feed: rename and keep the listed columns, ids to nullable integers, no-signal rows dropped."""
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, rename, "feed")
    cols = []
    for src, dst in rename.items():
        c = F.col(f"`{src}`")
        if dst in ("ran_type", "band"):
            cols.append(c.alias(dst))
        elif dst.endswith("_id"):
            cols.append(c.try_cast("double").try_cast("long").alias(dst))
        else:
            cols.append(c.try_cast("double").alias(dst))
    out = nan_to_null(raw.select(*cols))
    return out.where(F.col("rsrp_serving_dbm") > -140.0) if drop_no_signal else out


def _resolve(columns: list[str], spellings: list[str]) -> str | None:
    by_name = {c.strip(): c for c in columns}
    return next((by_name[s] for s in spellings if s in by_name), None)


def read_sample_files(spark: SparkSession, paths: list[str], decode: bool = True, drop_missing_neighbor: bool = False) -> DataFrame:
    """Union of sample files with differing headers, deduplicated on the natural key and decoded.

    ``paths`` are files or globs; the files behind one entry share a header.
    """
    parts = []
    for p in paths:
        raw = spark.read.option("header", True).csv(p)
        cols = []
        for name, spellings in {**SAMPLE_HEADERS, **OPTIONAL_HEADERS}.items():
            hit = _resolve(raw.columns, spellings)
            if hit is None and name in SAMPLE_HEADERS:
                raise ValueError(f"{p} lacks a required column, tried {spellings}")
            cols.append((F.col(f"`{hit}`") if hit else F.lit(None).cast("string")).alias(name))
        d = raw.select(*cols, F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("source_file"))
        ds = F.regexp_extract("source_file", r"^Dataset_(\d+)_ver_\d+\.csv", 1)
        num = lambda c: F.col(c).try_cast("double")
        parts.append(
            d.select(
                F.when(ds != "", ds.cast("int")).otherwise(F.lit(-1)).alias("dataset_id"),
                "source_file",
                parse_time("timestamp").alias("time_s"),
                num("serving_cell_id").cast("long").alias("serving_cell_id"),
                num("neighbor_cell_id").cast("long").alias("neighbor_cell_id"),
                num("rsrp_serving").alias("rsrp_serving_raw"),
                num("rsrp_neighbor").alias("rsrp_neighbor_raw"),
                num("rsrq_serving").alias("rsrq_serving_raw"),
                num("rsrq_neighbor").alias("rsrq_neighbor_raw"),
                num("cinr_serving").alias("cinr_serving_db"),
                F.coalesce(num("handover_trigger"), F.lit(0.0)).cast("int").alias("handover_trigger"),
                *[num(c).alias(c) for c in OPTIONAL_HEADERS],
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    every = nan_to_null(out)
    if drop_missing_neighbor:
        every = every.where(F.col("rsrp_neighbor_raw").isNotNull())
    out = every.dropDuplicates(["dataset_id", "time_s", "serving_cell_id", "neighbor_cell_id", "rsrp_serving_raw", "rsrp_neighbor_raw"])
    if not decode:
        return out
    # Repeated rows do not change the notation, so one column of the files is read for it and nothing is shuffled.
    coded = every.agg(value_notation("rsrp_serving_raw").alias("n")).first()["n"]
    if coded == "unknown":
        return out
    rsrp, rsrq = (decode_rsrp, decode_rsrq) if coded == "coded" else (F.col, F.col)
    return out.withColumns(
        {
            "rsrp_serving_dbm": rsrp("rsrp_serving_raw"),
            "rsrp_neighbor_dbm": rsrp("rsrp_neighbor_raw"),
            "rsrq_serving_db": rsrq("rsrq_serving_raw"),
            "rsrq_neighbor_db": rsrq("rsrq_neighbor_raw"),
        }
    )


def read_event_files(spark: SparkSession, path: str, event: str | None = "Intra LTE-HO") -> DataFrame:
    """Event-statistics files: trimmed text, numeric coercion, channel field split, one event type kept."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.withColumnsRenamed({c: c.strip() for c in raw.columns})
    raw = raw.withColumn("_f", F.input_file_name())
    ds = F.regexp_extract("_f", r"Dataset_(\d+)", 1)
    whole = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast("int").alias(c.lower())
    out = raw.select(
        F.when(ds != "", ds.cast("int")).otherwise(F.lit(-1)).alias("dataset_id"),
        F.regexp_extract("_f", r"([^/]+)$", 1).alias("source_file"),
        parse_time("Time").alias("event_time_s"),
        F.trim("Event").alias("event_type"),
        F.trim("Result").alias("result"),
        *parse_channel("Freq"),
        whole("Attempt"),
        whole("Success"),
        whole("Fail"),
        F.col("Count").try_cast("double").alias("count"),
    )
    return out.where(F.col("event_type") == event) if event else out
