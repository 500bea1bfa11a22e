"""Sliding-window features per entity and phase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from .scale import HOT_GROUP_ROWS, largest_group, null_safe_join, pick_quantiles, ranked_quantiles, sorted_lists

# Measured columns, window quantiles and counted event types.
SAMPLE_COLUMNS = [
    "rsrp_serving_dbm",
    "rsrq_serving_db",
    "sinr_serving_db",
    "rsrp_neighbor_dbm",
    "rsrq_neighbor_db",
    "ue_speed_mps",
]
QUANTILES = {"p10": 0.10, "p50": 0.50, "p90": 0.90}
EVENT_TYPES = ["HO_ATTEMPT", "HO_SUCCESS", "HO_FAIL", "RLF", "PING_PONG"]
DERIVED = ["hosr", "hofr_rate", "rlf_rate", "ping_pong_rate"]
WINDOW_KEYS = ["ue_id", "phase_id", "window_s", "window_id"]
EPS = 1e-9


def count_columns() -> list[str]:
    return [f"n_{e.lower()}" for e in EVENT_TYPES]


def feature_columns() -> list[str]:
    """The 34 features in their fixed order."""
    measured = [f"{c}__{s}" for c in SAMPLE_COLUMNS for s in [*QUANTILES, "std"]]
    return [*measured, "serving_cell_mode", *count_columns(), *DERIVED]


def feature_families() -> dict[str, list[str]]:
    """Disjoint families that together cover every feature."""
    prefix = {"rsrp": "rsrp_", "rsrq": "rsrq_", "sinr": "sinr_", "speed": "ue_speed_"}
    families = {f: [c for c in feature_columns() if c.startswith(p)] for f, p in prefix.items()}
    families |= {"cell": ["serving_cell_mode"], "events": count_columns(), "derived": list(DERIVED)}
    covered = [c for cols in families.values() for c in cols]
    if sorted(covered) != sorted(feature_columns()):
        raise AssertionError("feature families must partition the feature columns")
    return families


def drop_family_sets() -> dict[str, list[str]]:
    """Feature sets for the ablation: all features, then each family left out."""
    sets = {"full": feature_columns()}
    for family, cols in feature_families().items():
        sets[f"drop_{family}"] = [c for c in feature_columns() if c not in cols]
    return sets


def check_windows(window_s: float, slide_s: float) -> None:
    if window_s <= 0 or slide_s <= 0:
        raise ValueError("window and slide must be positive")
    if slide_s > window_s:
        raise ValueError("slide must not exceed the window, samples would be lost")


def phase_bounds(samples: DataFrame) -> DataFrame:
    """First and last sample time and the first scenario name per (ue, phase).

    The name is a grouping key first: text in an aggregate buffer would force a sort of all samples.
    """
    named = samples.groupBy("ue_id", "phase_id", "scenario_name").agg(F.min("time_s").alias("_t_min"), F.max("time_s").alias("_t_max"))
    return named.groupBy("ue_id", "phase_id").agg(
        F.min("_t_min").alias("_t_min"),
        F.max("_t_max").alias("_t_max"),
        F.min_by("scenario_name", "_t_min").alias("scenario_name"),
    )


def place_in_windows(rows: DataFrame, bounds: DataFrame, time: str, sizes: list[tuple[float, float]]) -> DataFrame:
    """One output row per (input row, window that contains it).

    Windows start at t_min + k * slide of their own (ue, phase) and are half-open. The window index
    range is computed from the row time, widened by one and checked against the exact boundaries.
    """
    spec = ", ".join(f"struct({float(w)!r}D as w, {float(s)!r}D as s)" for w, s in sizes)
    rel = f"({time} - _t_min)"
    lo = f"greatest(0L, floor(({rel} - _size.w) / _size.s))"
    keep = [c for c in [*rows.columns, *bounds.columns] if c not in ("_t_min", "_t_max")]
    keep = ", ".join(dict.fromkeys(keep))
    d = rows.join(bounds, ["ue_id", "phase_id"]).selectExpr("*", f"explode(array({spec})) as _size")
    d = d.where(f"{rel} >= -_size.s").selectExpr(
        "*", f"explode(sequence({lo}, greatest({lo}, floor({rel} / _size.s) + 1))) as window_id"
    )
    d = d.selectExpr("*", "_size.w as window_s", "_t_min + window_id * _size.s as t_start_s").selectExpr("*", "t_start_s + window_s as t_end_s")
    d = d.where(f"{time} >= t_start_s AND {time} < t_end_s AND t_start_s < _t_max - window_s + {EPS!r}D")
    return d.selectExpr(*keep.split(", "), "window_s", "window_id", "t_start_s", "t_end_s")


def event_rates(window: str) -> list[str]:
    """Success ratio (NULL without outcomes) and per-time-unit rates from the window counts."""
    done = "n_ho_success + n_ho_fail"
    return [
        f"CASE WHEN {done} > 0 THEN n_ho_success / ({done}) END as hosr",
        f"n_ho_fail / {window} as hofr_rate",
        f"n_rlf / {window} as rlf_rate",
        f"n_ping_pong / {window} as ping_pong_rate",
    ]


def window_features(
    samples: DataFrame,
    events: DataFrame,
    window_s: float = 5.0,
    slide_s: float = 1.0,
    sizes: list[tuple[float, float]] | None = None,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Quantiles, spread, modal cell and event rates per (ue, phase, window size, window).

    ``sizes`` computes several (window, slide) pairs in the same pass. A window can span two
    neighbouring time bins of its own length, so the largest bin bounds the largest window; when
    windows may exceed ``hot_rows`` samples their quantiles are selected by distributed ranking.
    """
    sizes = sizes or [(window_s, slide_s)]
    for w, s in sizes:
        check_windows(w, s)
    require_columns(samples, ["ue_id", "time_s", "phase_id", "serving_cell_id", "scenario_name", *SAMPLE_COLUMNS], "samples")
    require_columns(events, ["ue_id", "event_time_s", "event_type", "phase_id"], "events")
    lean = samples.select("ue_id", "phase_id", "time_s", "serving_cell_id", *SAMPLE_COLUMNS)
    bounds = phase_bounds(samples)
    placed = place_in_windows(lean, bounds, "time_s", sizes)
    spec = {c: {f"{c}__{s}": p for s, p in QUANTILES.items()} for c in SAMPLE_COLUMNS}
    plain = [
        F.first("t_start_s").alias("t_start_s"),
        F.first("t_end_s").alias("t_end_s"),
        F.first("scenario_name").alias("scenario_name"),
        *[F.stddev_pop(c).alias(f"{c}__std") for c in SAMPLE_COLUMNS],
    ]
    widest = max(w for w, _ in sizes)
    bins = samples.select("ue_id", "phase_id", F.floor(F.col("time_s") / widest).alias("_bin"))
    if 2 * largest_group(bins, ["ue_id", "phase_id", "_bin"]) <= hot_rows:
        mode = F.mode("serving_cell_id", True).cast("int").alias("serving_cell_mode")
        feats = pick_quantiles(placed.groupBy(*WINDOW_KEYS).agg(*plain, mode, *sorted_lists(spec)), spec)
    else:
        feats = placed.groupBy(*WINDOW_KEYS).agg(*plain)
        feats = null_safe_join(feats, ranked_quantiles(placed, WINDOW_KEYS, spec), WINDOW_KEYS)
        cells = placed.groupBy(*WINDOW_KEYS, "serving_cell_id").agg(F.count(F.lit(1)).alias("_n"))
        top = cells.groupBy(*WINDOW_KEYS).agg(
            F.max_by("serving_cell_id", F.struct(F.when(F.col("serving_cell_id").isNotNull(), F.col("_n")), -F.col("serving_cell_id"))).cast("int").alias("serving_cell_mode")
        )
        feats = null_safe_join(feats, top, WINDOW_KEYS)
    hits = place_in_windows(
        events.select("ue_id", "phase_id", "event_time_s", "event_type"), bounds.drop("scenario_name"), "event_time_s", sizes
    )
    counts = hits.groupBy(*WINDOW_KEYS).agg(
        *[F.expr(f"count(CASE WHEN event_type = '{e}' THEN 1 END) as {c}") for e, c in zip(EVENT_TYPES, count_columns())]
    )
    # Both sides are already partitioned by the window key, so this join moves nothing.
    out = feats.join(counts, WINDOW_KEYS, "left").fillna(0, count_columns())
    return out.selectExpr(
        "ue_id",
        "phase_id",
        "scenario_name",
        "window_s",
        "window_id",
        "t_start_s",
        "t_end_s",
        "t_start_s + window_s / 2 as t_mid_s",
        *[c for c in feature_columns() if c not in DERIVED],
        *event_rates("window_s"),
    )
