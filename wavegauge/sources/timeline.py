"""Timeline bundles: readers, phase assembly and truth tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.columns import nan_to_null
from ..operators.scale import null_safe_join


def read_bundle(spark: SparkSession, folder: str, partition_filter: str | None = None) -> dict[str, DataFrame]:
    """Samples and events (required) and the truth tables (optional), with NaN turned into NULL."""
    out = {}
    for name, needed in (("samples", True), ("events", True), ("ground_truth_anomaly", False), ("ground_truth_drift", False)):
        try:
            df = spark.read.parquet(f"{folder}/{name}.parquet")
        except AnalysisException as exc:
            if needed:
                raise FileNotFoundError(f"{folder}: {name}.parquet is required") from exc
            continue
        if partition_filter and name in ("samples", "events"):
            df = df.where(partition_filter)
        out[name] = nan_to_null(df)
    return out


def read_entity_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Per-entity files of several configurations; the configuration is the folder name."""
    d = spark.read.parquet(pattern).withColumn("config", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    part = lambda k: F.regexp_extract("config", r"^isd(\d+)_area(\d+)", k)
    return d.withColumns({n: F.when(part(k) != "", part(k).cast("int")) for k, n in ((1, "isd_m"), (2, "area_m"))})


def phase_offsets(phases: DataFrame) -> DataFrame:
    """Start and end of every phase from running durations (one row per phase)."""
    w = Window.orderBy("phase_id")  # the phase list is a dimension
    return phases.withColumn("end_s", F.sum("duration_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "start_s", F.col("end_s") - F.col("duration_s")
    )


def assemble(rows: DataFrame, phases: DataFrame, time: str) -> DataFrame:
    """Shift phase-local times onto the global axis."""
    off = phase_offsets(phases).select("phase_id", F.col("start_s").alias("_off"))
    return null_safe_join(rows, off, ["phase_id"], "inner").withColumn(time, F.col(time) + F.col("_off")).drop("_off")


def renumber(events: DataFrame, time: str = "event_time_s", chunk: float = 3600.0) -> DataFrame:
    """Number events 1..N by (time, ue): ordered inside time chunks, offset by the chunks before."""
    d = events.withColumn("_chunk", F.floor(F.col(time) / chunk))
    sizes = d.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    offsets = sizes.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    order = [time, "ue_id"] + (["event_id"] if "event_id" in events.columns else [])
    local = Window.partitionBy("_chunk").orderBy(*order)
    out = d.withColumn("_k", F.row_number().over(local)).join(offsets, "_chunk")
    return out.withColumn("event_id", (F.col("_off") + F.col("_k")).cast("long")).drop("_chunk", "_k", "_off")


def drift_bounds(drift: DataFrame, phases: DataFrame) -> DataFrame:
    """Global start of the first and end of the last phase of each drift."""
    off = phase_offsets(phases)
    a = off.select(F.col("phase_id").alias("phase_id_start"), F.col("start_s").alias("start_time_s"))
    b = off.select(F.col("phase_id").alias("phase_id_end"), F.col("end_s").alias("end_time_s"))
    return drift.join(a, "phase_id_start").join(b, "phase_id_end")


def anomaly_truth(specs: DataFrame, phases: DataFrame) -> DataFrame:
    """Global intervals, scopes as ``all`` or a comma list, severity = first given of three fields."""
    off = phase_offsets(phases).select("phase_id", F.col("start_s").alias("_off"))

    def scope(c: str):
        return F.when(F.col(c).isNull() | (F.size(c) == 0), F.lit("all")).otherwise(F.array_join(F.col(c).cast("array<string>"), ","))

    return null_safe_join(specs, off, ["phase_id"], "inner").select(
        "anomaly_id",
        "anomaly_type",
        "phase_id",
        (F.col("t_start_s") + F.col("_off")).alias("t_start_s"),
        (F.col("t_end_s") + F.col("_off")).alias("t_end_s"),
        scope("ue_ids").alias("affected_ue_ids"),
        scope("cell_ids").alias("affected_cell_ids"),
        F.coalesce("delta_db", "rate_db_per_s", "stuck_value_dbm").alias("severity"),
    )
