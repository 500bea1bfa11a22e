"""Interval truth labels for windows and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import id_list, tag_list
from .joins import Bins, interval_join

# KPI tags that each stream answers to.
STREAM_TAGS = {
    "rsrp_serving_mean": ["rsrp_serving_dbm"],
    "sinr_serving_mean": ["sinr_serving_db"],
    "ho_rate_rolling": ["event_rate", "ho_rate"],
    "hosr_rolling": ["hosr"],
    "ping_pong_rate_rolling": ["ping_pong_rate"],
    "rlf_rate_rolling": ["rlf_rate"],
}


def parse_truth(truth: DataFrame) -> DataFrame:
    """Scopes as integer arrays (NULL = everything)."""
    cells = id_list("affected_cell_ids") if "affected_cell_ids" in truth.columns else F.lit(None).cast("array<int>")
    return truth.select(
        F.col("anomaly_id").cast("string").alias("anomaly_id"),
        "anomaly_type",
        F.col("t_start_s").cast("double").alias("a_start"),
        F.col("t_end_s").cast("double").alias("a_end"),
        id_list("affected_ue_ids").alias("a_ues"),
        cells.alias("a_cells"),
    )


def _in_scope(scope: Column, value: Column) -> Column:
    return scope.isNull() | F.coalesce(F.array_contains(scope, value), F.lit(False))


def _by_bin(truth: DataFrame, start: str, end: str, bins: Bins, reach: int = 0) -> DataFrame:
    """Truth rows gathered by time bin (``_bin``, ``_truth``), also for the ``reach`` bins before each."""
    first, last = bins.of(start) - reach, bins.of(end)
    spread = truth.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(first, last)))
    return spread.groupBy("_bin").agg(F.collect_list(F.struct(*truth.columns)).alias("_truth"))


def label_windows(windows: DataFrame, truth: DataFrame, longest_s: float | None = None) -> DataFrame:
    """Add ``active_ids`` (sorted array), ``active_anomaly_id`` (text) and ``label_anomaly`` (0/1).

    A window is positive when a truth interval overlaps it and both its entity and its modal cell
    are in scope. A window table without a modal cell matches only unrestricted cell scopes,
    because its cell is taken as -1.

    Every row is labelled on its own, by one lookup of the time bin in which it starts: bins are as
    long as the longest window, so a bin and the next hold all that may overlap. On a stream the
    longest window cannot be measured and is given as ``longest_s``; longer rows raise an error.
    """
    w = windows if "serving_cell_mode" in windows.columns else windows.withColumn("serving_cell_mode", F.lit(-1))
    t = parse_truth(truth)
    ue, cell = F.col("ue_id").cast("int"), F.col("serving_cell_mode").cast("int")
    length = F.col("t_end_s") - F.col("t_start_s")
    if longest_s is None:
        if windows.isStreaming:
            raise ValueError("give longest_s for a stream")
        longest_s = w.agg(F.max(length)).first()[0] or 1.0
    else:
        w = w.where(F.when(length > longest_s, F.raise_error(F.lit(f"a window is longer than {longest_s} s")).cast("boolean")).otherwise(F.lit(True)))
    typical = Bins(t, "a_start", "a_end")
    bins = Bins(t, "a_start", "a_end", max(float(longest_s), typical.width))
    hit = F.filter(
        "_truth",
        lambda a: (F.col("t_start_s") < a["a_end"])
        & (a["a_start"] < F.col("t_end_s"))
        & _in_scope(a["a_ues"], ue)
        & _in_scope(a["a_cells"], cell),
    )
    ids = F.array_sort(F.array_distinct(F.transform(hit, lambda a: a["anomaly_id"])))
    out = w.withColumn("_bin", bins.of("t_start_s")).join(_by_bin(t, "a_start", "a_end", bins, 1), "_bin", "left")
    out = out.withColumn("active_ids", F.coalesce(ids, F.array().cast("array<string>"))).drop("_bin", "_truth")
    return out.withColumns(
        {
            "active_anomaly_id": F.array_join("active_ids", ","),
            "label_anomaly": (F.size("active_ids") > 0).cast("int"),
        }
    )


def label_per_id(labelled: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Long 0/1 labels: one row per (window, anomaly id)."""
    ids = truth.select(F.col("anomaly_id").cast("string").alias("anomaly_id")).distinct()
    packed = ids.agg(F.array_sort(F.collect_set("anomaly_id")).alias("_ids"))  # distinct ids only
    return labelled.crossJoin(F.broadcast(packed)).select(
        *keys, "active_ids", F.explode("_ids").alias("anomaly_id")
    ).select(*keys, "anomaly_id", F.array_contains("active_ids", F.col("anomaly_id")).cast("int").alias("label"))


def label_per_type(labelled: DataFrame, truth: DataFrame, keep: list[str]) -> DataFrame:
    """Long labels per anomaly type, restricted to the phases in which that type occurs."""
    types = truth.groupBy("anomaly_type").agg(
        F.collect_set(F.col("anomaly_id").cast("string")).alias("_ids"), F.collect_set("phase_id").alias("_phases")
    )
    packed = types.agg(F.collect_list(F.struct("anomaly_type", "_ids", "_phases")).alias("_types"))
    long = labelled.crossJoin(F.broadcast(packed)).withColumn("_x", F.explode("_types"))
    return long.where(F.array_contains("_x._phases", F.col("phase_id"))).select(
        *keep,
        F.col("_x.anomaly_type").alias("anomaly_type"),
        F.arrays_overlap("active_ids", "_x._ids").cast("int").alias("label"),
    )


def label_streams(streams: DataFrame, drift: DataFrame) -> DataFrame:
    """Add ``label_drift`` and ``active_drift_ids`` to a long stream table.

    A point is positive when a drift interval [start, end) contains it and the drift's KPI tags
    meet the tags of the stream.
    """
    tags = F.create_map(*[x for s, t in STREAM_TAGS.items() for x in (F.lit(s), F.array(*[F.lit(v) for v in t]))])
    d = drift.select(
        F.col("drift_id").cast("string").alias("drift_id"),
        F.col("start_time_s").cast("double").alias("d_start"),
        F.col("end_time_s").cast("double").alias("d_end"),
        tag_list("affected_kpis").alias("d_tags"),
    )
    own = F.coalesce(F.element_at(tags, F.col("stream_name")), F.array().cast("array<string>"))
    bins = Bins(d, "d_start", "d_end")
    hit = F.filter(
        "_truth",
        lambda a: (F.col("time_s") >= a["d_start"]) & (F.col("time_s") < a["d_end"]) & F.arrays_overlap(a["d_tags"], F.col("_own")),
    )
    out = streams.withColumns({"_own": own, "_bin": bins.of("time_s")}).join(_by_bin(d, "d_start", "d_end", bins), "_bin", "left")
    ids = F.array_sort(F.array_distinct(F.transform(hit, lambda a: a["drift_id"])))
    out = out.withColumn("_ids", F.coalesce(ids, F.array().cast("array<string>"))).drop("_truth", "_own", "_bin")
    return out.withColumns(
        {"label_drift": (F.size("_ids") > 0).cast("int"), "active_drift_ids": F.array_join("_ids", ",")}
    ).drop("_ids")


def drift_phases(windows: DataFrame, drift: DataFrame) -> DataFrame:
    """Distinct phases with a window midpoint inside a drift interval."""
    d = drift.select(F.col("start_time_s").alias("d_start"), F.col("end_time_s").alias("d_end"))
    return interval_join(windows.select("t_mid_s", "phase_id"), d, "t_mid_s", "d_start", "d_end", how="left_semi").select(
        "phase_id"
    ).distinct()
