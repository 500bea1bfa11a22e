"""Drift detection on long stream tables and the metrics of a firing log."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detectors as D
from .joins import interval_join
from .ranking import bootstrap_statistic
from .scale import grouped_quantiles, null_safe_join, prefix_sum

FIRING_SCHEMA = "stream_name string, detector string, time_s double"


def run_sequential(streams: DataFrame, registry: dict[str, Callable] | None = None) -> DataFrame:
    """Firing log of every sequential detector on every stream, fresh state per pair.

    The pairs are spread over tasks; within a task rows arrive in time order in Arrow batches and
    only the detector state is kept, so the length of a stream does not matter for memory.
    """
    registry = registry or D.SEQUENTIAL
    names = F.explode(F.array(*[F.lit(n) for n in registry])).alias("detector")
    # Aggregated grid rows, not raw samples: one row per grid step and stream.
    rows = streams.where(F.col("value").isNotNull()).select("stream_name", "time_s", "value", names)
    # A fixed width: the rows are few but slow to process, so they must not be coalesced.
    width = max(8, int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = rows.repartition(width, "stream_name", "detector").sortWithinPartitions("stream_name", "detector", "time_s")

    def detect(batches):
        pair, det = None, None
        for pdf in batches:
            out = []
            for s, d, t, v in zip(pdf["stream_name"], pdf["detector"], pdf["time_s"], pdf["value"]):
                if (s, d) != pair:
                    pair, det = (s, d), registry[d]()
                if det.update(float(v)):
                    out.append((s, d, t))
            yield pd.DataFrame(out, columns=["stream_name", "detector", "time_s"])

    return rows.mapInPandas(detect, FIRING_SCHEMA)


def numbered(streams: DataFrame) -> DataFrame:
    """0-based index of the non-NULL values of each stream as ``idx``."""
    d = streams.where(F.col("value").isNotNull()).select("stream_name", "time_s", "value").withColumn("_one", F.lit(1).cast("long"))
    return prefix_sum(d, ["stream_name"], "time_s", ["_one"]).select(
        "stream_name", "time_s", "value", (F.col("cum__one") - 1).alias("idx")
    )


def binarise(streams: DataFrame, direction: str = "absdev_zscore", threshold: float = 0.0, z: float = 2.0, warmup: int = 30) -> DataFrame:
    """Error bits of each stream; the z-score rule uses the first ``warmup`` values and skips them."""
    d = streams.where(F.col("value").isNotNull())
    if direction in ("high", "low"):
        bit = F.col("value") >= threshold if direction == "high" else F.col("value") <= threshold
        return d.select("stream_name", "time_s", "value", bit.cast("int").alias("error"))
    if direction != "absdev_zscore":
        raise ValueError(f"unknown direction {direction!r}")
    first = Window.partitionBy("stream_name").orderBy("time_s")
    head = d.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= warmup)  # top-k per stream
    ref = head.groupBy("stream_name").agg(
        F.avg("value").alias("_m"), F.stddev_pop("value").alias("_sd"), F.max("time_s").alias("_end"), F.count(F.lit(1)).alias("_n")
    )
    j = null_safe_join(d, ref.where(F.col("_n") >= warmup), ["stream_name"], "inner").where(F.col("time_s") > F.col("_end"))
    sd = F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    return j.select("stream_name", "time_s", "value", (F.abs(F.col("value") - F.col("_m")) / sd >= z).cast("int").alias("error"))


def reference_tests(streams: DataFrame, ref_size: int = 60, active_size: int = 60, step: int = 5) -> DataFrame:
    """One row per (stream, test): the reference and the active window as arrays of fixed size.

    The reference is the first ``ref_size`` values and never changes; the active window trails by
    ``active_size`` values and is never cleared, so all tests are independent of each other.
    """
    n = numbered(streams)
    ref = n.where(F.col("idx") < ref_size).groupBy("stream_name").agg(
        F.sort_array(F.collect_list(F.struct("idx", "value"))).alias("_r"), F.count(F.lit(1)).alias("_n")
    )
    ref = ref.where(F.col("_n") == ref_size).select("stream_name", F.transform("_r", lambda x: x["value"]).alias("ref"))
    first_test = ref_size + active_size - 1 + (step - 1)
    # Value idx is in the window of tests t with end - active_size < idx <= end, end = first_test + step * t.
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("idx") - first_test) / step))
    hi = F.floor((F.col("idx") + active_size - 1 - first_test) / step)
    d = n.where((F.col("idx") >= ref_size) & (hi >= lo)).withColumn("test", F.explode(F.sequence(lo, hi)))
    act = d.groupBy("stream_name", "test").agg(
        F.sort_array(F.collect_list(F.struct("idx", "value", "time_s"))).alias("_a"), F.count(F.lit(1)).alias("_n")
    )
    act = act.where(F.col("_n") == active_size).select(
        "stream_name", "test", F.element_at("_a", -1)["time_s"].alias("time_s"), F.transform("_a", lambda x: x["value"]).alias("act")
    )
    return null_safe_join(act, ref, ["stream_name"], "inner")


TEST_SCHEMA = "stream_name string, detector string, test long, time_s double, statistic double, p_value double"


def window_tests(tests: DataFrame, n_perm: int = 100, seed: int = 42) -> DataFrame:
    """MMD and energy statistics with permutation p-values, one row per (stream, test, detector)."""
    width = max(1, int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    spread = tests.repartition(width, "stream_name", "test")

    def run(batches):
        for pdf in batches:
            out = []
            for s, test, t, act, ref in zip(pdf["stream_name"], pdf["test"], pdf["time_s"], pdf["act"], pdf["ref"]):
                ref, act = np.asarray(ref, float), np.asarray(act, float)
                rng = np.random.default_rng([seed, zlib.crc32(s.encode()), int(test)])
                labels = np.zeros((n_perm, len(ref) + len(act)))
                labels[:, : len(ref)] = 1.0
                labels = rng.permuted(labels, axis=1) if n_perm else labels
                gamma = D.rbf_gamma(ref)
                for name, stat in (
                    ("MMD-batch", lambda lab=None: D.mmd2(ref, act, gamma, lab)),
                    ("Energy-batch", lambda lab=None: D.energy(ref, act, lab)),
                ):
                    obs = float(stat()[0])
                    p = (float((stat(labels) >= obs).sum()) + 1) / (n_perm + 1) if n_perm else None
                    out.append((s, name, test, t, obs, p))
            yield pd.DataFrame(out, columns=["stream_name", "detector", "test", "time_s", "statistic", "p_value"])

    return spread.select("stream_name", "test", "time_s", "act", "ref").mapInPandas(run, TEST_SCHEMA)


def run_detectors(streams: DataFrame, alpha: float = 0.01, n_perm: int = 100) -> DataFrame:
    """Firing log of all seven detectors."""
    batch = window_tests(reference_tests(streams), n_perm).where(F.col("p_value") < alpha)
    return run_sequential(streams).unionByName(batch.select("stream_name", "detector", "time_s"))


def energy_distance(df: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """Energy distance of two whole columns: ``side`` is 1 for the first sample and 0 for the second."""
    d = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.sum(F.col(side).cast("long")).alias("_a"), F.sum((1 - F.col(side)).cast("long")).alias("_b")
    )
    r = prefix_sum(d, keys, "_v", ["_a", "_b"], with_next=True)
    gap = F.col("cum__a") / F.col("tot__a") - F.col("cum__b") / F.col("tot__b")
    return r.groupBy(*keys).agg(
        F.sqrt(2 * F.sum(gap * gap * (F.col("next__v") - F.col("_v")))).alias("energy"),
        F.max("tot__a").alias("n_first"),
        F.max("tot__b").alias("n_second"),
    )


# --- firing-log metrics ------------------------------------------------------------------------


def drift_instances(drift: DataFrame, order: str = "start_time_s") -> DataFrame:
    """Number the repeats of a drift id: ``D-2#1``, ``D-2#2`` in table order."""
    w = Window.partitionBy("drift_id").orderBy(order)
    return drift.withColumn(
        "drift_instance", F.concat_ws("#", F.col("drift_id"), F.row_number().over(w).cast("string"))
    )


def detection_latency(
    firings: DataFrame, drift: DataFrame, max_latency: float | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """Earliest firing per (instance, detector, stream) in [start, end + max_latency).

    The grid holds the detectors and the streams that fired at least once, or ``pairs`` (detector,
    stream_name) when a full roster is wanted.
    """
    inst = drift_instances(drift).select("drift_instance", "drift_id", "start_time_s", "end_time_s")
    inst = inst.withColumn("_until", F.col("end_time_s") + F.lit(30.0 if max_latency is None else float(max_latency)))
    hit = interval_join(firings, inst.select("drift_instance", "start_time_s", "_until"), "time_s", "start_time_s", "_until")
    first = hit.groupBy("drift_instance", "detector", "stream_name").agg(F.min("time_s").alias("detection_time_s"))
    if pairs is None:
        names = firings.agg(F.collect_set("detector").alias("_d"), F.collect_set("stream_name").alias("_s"))
        pairs = names.select(F.explode("_d").alias("detector"), "_s").select("detector", F.explode("_s").alias("stream_name"))
    packed = pairs.agg(F.collect_set(F.struct("detector", "stream_name")).alias("_p"))  # names only
    full = inst.crossJoin(F.broadcast(packed)).select(
        "drift_instance", "drift_id", "start_time_s", "end_time_s", F.explode("_p").alias("_p")
    ).select("drift_instance", "drift_id", "start_time_s", "end_time_s", "_p.detector", "_p.stream_name")
    out = null_safe_join(full, first, ["drift_instance", "detector", "stream_name"])
    return out.withColumns(
        {
            "latency_s": F.col("detection_time_s") - F.col("start_time_s"),
            "missed": F.col("detection_time_s").isNull().cast("int"),
        }
    )


def false_alarm_rate(firings: DataFrame, streams: DataFrame) -> DataFrame:
    """Firings on baseline points per baseline time step; without firings every stream reports ``<none>``."""
    base = streams.where(F.col("scenario_name") == "baseline").select("stream_name", F.round("time_s", 6).alias("_t"))
    budget = base.groupBy("stream_name").agg(F.count(F.lit(1)).alias("n_baseline_s"))
    if firings.limit(1).count() == 0:
        return budget.select(
            F.lit("<none>").alias("detector"), "stream_name", "n_baseline_s",
            F.lit(0).cast("long").alias("n_false_alarms"), F.lit(0.0).alias("fpr_per_s"),
        )
    f = firings.select("detector", "stream_name", F.round("time_s", 6).alias("_t"))
    hits = f.join(base.distinct(), ["stream_name", "_t"], "left_semi").groupBy("detector", "stream_name").agg(
        F.count(F.lit(1)).alias("n_false_alarms")
    )
    out = f.groupBy("detector", "stream_name").agg(F.lit(1).alias("_x"))
    out = out.join(hits, ["detector", "stream_name"], "left").join(budget, "stream_name", "left")
    out = out.fillna(0, ["n_false_alarms", "n_baseline_s"]).drop("_x")
    return out.withColumn("fpr_per_s", F.when(F.col("n_baseline_s") > 0, F.col("n_false_alarms") / F.col("n_baseline_s")))


def drift_type(types: dict[str, str]) -> Column:
    c = F.lit("other")
    for k, v in types.items():
        c = F.when(F.col("drift_id") == k, v).otherwise(c)
    return c


def latency_summary(latency: DataFrame, types: dict[str, str], reps: int = 1000, alpha: float = 0.05) -> DataFrame:
    """Best stream per (detector, type) by median latency, with a resampled interval of that median.

    ``n_detected`` and ``miss_rate`` count (instance, stream) pairs.
    """
    d = latency.withColumn("drift_type", drift_type(types))
    keys = ["detector", "drift_type"]
    med = grouped_quantiles(d.where(F.col("latency_s").isNotNull()), [*keys, "stream_name"], {"latency_s": {"_med": 0.5}})
    best = med.groupBy(*keys).agg(F.min_by("stream_name", F.struct("_med", "stream_name")).alias("best_stream"))
    totals = d.groupBy(*keys).agg(
        F.countDistinct("drift_instance").alias("n_drifts"),
        F.count(F.when(F.col("missed") == 0, 1)).alias("n_detected"),
        F.avg("missed").alias("miss_rate"),
    )
    chosen = null_safe_join(d, best, keys, "inner").where(F.col("stream_name") == F.col("best_stream"))
    ci = bootstrap_statistic(chosen, keys, "latency_s", "median", reps, alpha).select(
        *keys, F.col("median").alias("median_latency_s"), F.col("ci_low").alias("ci_low_s"), F.col("ci_high").alias("ci_high_s")
    )
    out = null_safe_join(null_safe_join(totals, best, keys), ci, keys)
    return out.withColumn("best_stream", F.coalesce("best_stream", F.lit("<none>")))


def miss_rates(latency: DataFrame, types: dict[str, str]) -> DataFrame:
    """Share of drift instances no stream detected, per (detector, type)."""
    d = latency.withColumn("drift_type", drift_type(types))
    inst = d.groupBy("detector", "drift_type", "drift_instance").agg(F.min("missed").alias("missed"))
    return inst.groupBy("detector", "drift_type").agg(
        F.count(F.lit(1)).alias("n_drifts"), F.sum("missed").alias("n_missed"), F.avg("missed").alias("miss_rate")
    )


def winning_detector(summary: DataFrame, missed_as: float = 60.0) -> DataFrame:
    """Detector with the lowest mean of its median latencies; a missed type counts ``missed_as``."""
    d = summary.groupBy("detector").agg(F.avg(F.coalesce("median_latency_s", F.lit(missed_as))).alias("mean_latency_s"))
    return d.agg(F.min_by("detector", F.struct("mean_latency_s", "detector")).alias("winner"), F.min("mean_latency_s").alias("mean_latency_s"))


def latency_matrix(summary: DataFrame, types: list[str]) -> DataFrame:
    return summary.groupBy("detector").pivot("drift_type", types).agg(F.first("median_latency_s"))
