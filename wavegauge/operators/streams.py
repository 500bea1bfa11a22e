"""Fleet-level time series on a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, require_columns
from ..session import materialise
from .joins import asof_join
from .labels import STREAM_TAGS
from .windows import EVENT_TYPES

STREAM_NAMES = list(STREAM_TAGS)


def grid_bounds(samples: DataFrame, cadence: float) -> tuple[float, int]:
    """Grid origin floor(t_min) and number of points up to ceil(t_max); two scalars leave Spark."""
    row = samples.agg(F.floor(F.min("time_s")).alias("lo"), F.ceil(F.max("time_s")).alias("hi")).first()
    lo, hi = float(row["lo"]), float(row["hi"])
    # Points lo, lo+c, ... strictly below hi + c.
    n = int(-(-(hi + cadence - lo) // cadence))
    return lo, n


def grid(spark, lo: float, n: int, cadence: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(lo) + F.col("id") * F.lit(cadence)).alias("time_s"))


def phase_at(samples: DataFrame, points: DataFrame, cadence: float) -> DataFrame:
    """Phase and scenario of the first sample in each bucket; gaps take the previous, then the next bucket."""
    named = samples.groupBy(F.floor(F.col("time_s") / cadence).alias("_bin"), "phase_id", "scenario_name").agg(F.min("time_s").alias("_t"))
    first = named.groupBy("_bin").agg(F.min_by(F.struct("phase_id", "scenario_name"), "_t").alias("_p"))
    first = first.select("_bin", F.col("_p.phase_id").alias("phase_id"), F.col("_p.scenario_name").alias("scenario_name"))
    first = materialise(first, "phases")  # one row per bucket, read by both lookups
    pts = points.withColumn("_at", F.floor(F.col("time_s") / cadence))
    cols = ["phase_id", "scenario_name"]
    back = asof_join(pts, first, "_at", "_bin", cols, chunk=4096.0)
    ahead = asof_join(pts, first, "_at", "_bin", cols, chunk=4096.0, forward=True).select(
        "i", *[F.col(c).alias(f"_n_{c}") for c in cols]
    )
    out = back.join(ahead, "i")
    return out.select("i", "time_s", *[F.coalesce(F.col(c), F.col(f"_n_{c}")).alias(c) for c in cols])


def bucket_means(samples: DataFrame, lo: float, n: int, cadence: float, columns: dict[str, str]) -> DataFrame:
    """Mean of each column over [grid[i], grid[i] + cadence)."""
    i = F.floor((F.col("time_s") - F.lit(lo)) / F.lit(cadence))
    return (
        samples.groupBy(i.alias("i")).agg(*[F.avg(c).alias(name) for c, name in columns.items()])
        .where((F.col("i") >= 0) & (F.col("i") < n))
    )


def rolling_counts(events: DataFrame, lo: float, n: int, cadence: float, window: float) -> DataFrame:
    """Events of every type in (t - window, t] at each grid point t.

    Events are first counted per grid step, then each step is added to the few points whose window
    covers it: no ordering of the whole timeline is needed.
    """
    step = F.ceil((F.col("event_time_s") - F.lit(lo)) / F.lit(cadence))
    counts = [F.count(F.when(F.col("event_type") == e, 1)).alias(e) for e in EVENT_TYPES]
    on_grid = (F.col("i") >= 0) & (F.col("i") < n)
    steps = window / cadence
    if steps == int(steps):
        # Step j holds (grid[j-1], grid[j]] and reaches the points j .. j + steps - 1.
        per_step = events.groupBy(step.alias("_j")).agg(*counts)
        spread = per_step.withColumn("i", F.explode(F.sequence(F.col("_j"), F.col("_j") + int(steps) - 1)))
        return spread.where(on_grid).groupBy("i").agg(*[F.sum(e).alias(e) for e in EVENT_TYPES])
    last = F.ceil((F.col("event_time_s") + F.lit(window) - F.lit(lo)) / F.lit(cadence))
    d = events.withColumn("i", F.explode(F.sequence(step, F.greatest(step, last))))
    t = F.lit(lo) + F.col("i") * F.lit(cadence)
    d = d.where((F.col("event_time_s") <= t) & (F.col("event_time_s") > t - F.lit(window)) & on_grid)
    return d.groupBy("i").agg(*counts)


def build_streams(samples: DataFrame, events: DataFrame, cadence: float = 1.0, window: float = 10.0) -> DataFrame:
    """Six fleet streams in long form: time_s, stream_name, value, phase_id, scenario_name."""
    if cadence <= 0 or window < cadence:
        raise ValueError("cadence must be positive and not exceed the rolling window")
    require_columns(samples, ["time_s", "phase_id", "scenario_name", "rsrp_serving_dbm", "sinr_serving_db"], "samples")
    require_columns(events, ["event_time_s", "event_type"], "events")
    lo, n = grid_bounds(samples, cadence)
    points = phase_at(samples, grid(samples.sparkSession, lo, n, cadence), cadence)
    means = bucket_means(samples, lo, n, cadence, {"rsrp_serving_dbm": "_rsrp", "sinr_serving_db": "_sinr"})
    counts = rolling_counts(events, lo, n, cadence, window)
    wide = points.join(means, "i", "left").join(counts, "i", "left").fillna(0, EVENT_TYPES)

    def rate(e: str) -> Column:
        return F.col(e) / F.lit(float(window))

    s, f = F.col("HO_SUCCESS"), F.col("HO_FAIL")
    values = {
        "rsrp_serving_mean": F.col("_rsrp"),
        "sinr_serving_mean": F.col("_sinr"),
        "ho_rate_rolling": rate("HO_ATTEMPT"),
        "hosr_rolling": ratio(s, s + f),
        "ping_pong_rate_rolling": rate("PING_PONG"),
        "rlf_rate_rolling": rate("RLF"),
    }
    stack = F.array(*[F.struct(F.lit(k).alias("stream_name"), v.cast("double").alias("value")) for k, v in values.items()])
    return wide.select("i", "time_s", "phase_id", "scenario_name", F.explode(stack).alias("_s")).select(
        "i", "time_s", F.col("_s.stream_name").alias("stream_name"), F.col("_s.value").alias("value"), "phase_id", "scenario_name"
    )


def pivot_streams(streams: DataFrame) -> DataFrame:
    """One row per time with a column per stream, in the fixed order."""
    return streams.groupBy("time_s").pivot("stream_name", STREAM_NAMES).agg(F.first("value"))
