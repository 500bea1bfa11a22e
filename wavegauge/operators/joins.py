"""Range, overlap and as-of joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .scale import BROADCAST_ROWS, fits, fitting_chunk, null_safe_join, place_among, prefix_sum

# Up to this many distinct probe times, an as-of join needs no ordering of the looked-up table.
FEW_PROBES = 127


class Bins:
    """Time bins for a table of intervals: as wide as its intervals on average.

    The table then covers at most three bins per interval (in total), so its size after binning is
    known from its row count. Ends beyond the finite range of the table fall into its outer bins.
    """

    def __init__(self, intervals: DataFrame, start: str, end: str, width: float | None = None):
        inf = float("inf")
        a, b = F.col(start).cast("double"), F.col(end).cast("double")
        finite = lambda c: F.when((F.abs(c) < inf) & ~F.isnan(c), c)
        row = intervals.agg(
            F.count(F.lit(1)).alias("n"), F.avg(finite(b - a)).alias("w"), F.min(finite(F.least(a, b))).alias("lo"), F.max(finite(F.greatest(a, b))).alias("hi")
        ).first()
        self.rows = row["n"]
        self.width = width or (row["w"] if row["w"] and row["w"] > 0 else 1.0)
        self.lo, self.hi = float(row["lo"] or 0.0), float(row["hi"] or 0.0)

    def of(self, time: str | Column) -> Column:
        """Bin of a time; NULL stays NULL."""
        t = F.col(time).cast("double") if isinstance(time, str) else time
        return F.floor(F.when(t < self.lo, self.lo).when(t > self.hi, self.hi).otherwise(t) / self.width)

    def spread(self, df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        """Rows once for each bin they cover; rows that end before they start cover none."""
        return df.where(F.col(start) <= F.col(end)).withColumn(name, F.explode(F.sequence(self.of(start), self.of(end))))

    def side(self, binned: DataFrame, cap: int) -> DataFrame:
        """Broadcast the binned table if its rows were counted to be few."""
        return F.broadcast(binned) if self.rows <= cap else binned


class LengthClasses:
    """An index of intervals by powers of two of their length, each class with bins of its own width.

    An interval lies in the class whose bins are at least as wide as itself, so it covers two bins at most,
    whatever the other intervals look like; a point asks one bin of every class that occurs. A few very
    long intervals thus cost a point one more lookup instead of widening the bins of all. Ends beyond the
    finite range of the table count as its borders.
    """

    def __init__(self, intervals: DataFrame, start: str, end: str):
        inf = float("inf")
        a, b = F.col(start).cast("double"), F.col(end).cast("double")
        finite = lambda c: F.when((F.abs(c) < inf) & ~F.isnan(c), c)
        row = intervals.agg(F.count(F.lit(1)).alias("n"), F.min(finite(F.least(a, b))).alias("lo"), F.max(finite(F.greatest(a, b))).alias("hi")).first()
        self.rows, self.lo, self.hi = row["n"], float(row["lo"] or 0.0), float(row["hi"] or 0.0)
        # A bin number keeps within 2^40, so that it is exact.
        self.least = math.floor(math.log2(max(abs(self.lo), abs(self.hi), 1e-300))) - 40
        some = intervals.where(a <= b).select(self.level(start, end).alias("c")).distinct()
        self.levels = sorted(r["c"] for r in some.collect())  # at most one a power of two

    def clip(self, time: str | Column) -> Column:
        t = F.col(time).cast("double") if isinstance(time, str) else time
        return F.when(t < self.lo, self.lo).when(t > self.hi, self.hi).otherwise(t)

    def level(self, start: str, end: str) -> Column:
        length = self.clip(end) - self.clip(start)
        return F.when(length > 0, F.greatest(F.ceil(F.log2(length)), F.lit(self.least))).otherwise(F.lit(self.least)).cast("int")

    def of(self, time: str | Column, level: Column) -> Column:
        """Bin of a time in a class; NULL stays NULL."""
        return F.floor(self.clip(time) / F.pow(F.lit(2.0), level))

    def spread(self, df: DataFrame, start: str, end: str, name: str) -> DataFrame:
        """Rows once for each bin of their class that they cover; rows that end before they start cover none."""
        d = df.where(F.col(start) <= F.col(end)).withColumn(f"{name}_level", self.level(start, end))
        return d.withColumn(name, F.explode(F.sequence(self.of(start, F.col(f"{name}_level")), self.of(end, F.col(f"{name}_level")))))

    def probe(self, df: DataFrame, name: str) -> DataFrame:
        """Rows once for each class that occurs."""
        return df.withColumn(f"{name}_level", F.explode(F.array(*[F.lit(c) for c in self.levels]).cast("array<int>")))

    def side(self, binned: DataFrame, cap: int) -> DataFrame:
        """Broadcast the binned table if its rows were counted to be few."""
        return F.broadcast(binned) if self.rows <= cap else binned


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    t: str,
    start: str,
    end: str,
    on: list[str] | None = None,
    closed: bool = False,
    how: str = "inner",
    cap: int = BROADCAST_ROWS,
) -> DataFrame:
    """Match points with the intervals that contain them: [start, end), or [start, end] if closed.

    Points and intervals meet on a bin of a length class, so the join is a hash or sort-merge equi join at
    every size; up to ``cap`` intervals (counted) are broadcast by bin. Column names must not clash except
    for ``on``. ``how`` is inner, left_semi or left; the latter two compare whole rows where intervals of
    several classes occur, whose columns must then have an order.
    """
    on = on or []
    iv = intervals.withColumnsRenamed({k: f"_iv_{k}" for k in on})
    cond = (F.col(t) >= F.col(start)) & ((F.col(t) <= F.col(end)) if closed else (F.col(t) < F.col(end)))
    for k in on:
        cond = cond & (F.col(k) == F.col(f"_iv_{k}"))
    index = LengthClasses(intervals, start, end)
    binned = index.side(index.spread(iv, start, end, "_ib"), cap)
    cond = cond & (F.col("_pb") == F.col("_ib")) & (F.col("_pb_level") == F.col("_ib_level"))
    helpers = ["_pb", "_pb_level", "_ib", "_ib_level", *[f"_iv_{k}" for k in on]]

    def meet(rows: DataFrame, kind: str) -> DataFrame:
        probes = index.probe(rows, "_pb").withColumn("_pb", index.of(t, F.col("_pb_level")))
        return probes.join(binned, cond, kind).drop(*helpers)

    if how == "inner":
        return meet(points, how)
    if len(index.levels) == 1:
        return meet(points, how)
    if not index.levels:  # no interval at all
        none = points.withColumns({"_pb": F.lit(None).cast("long"), "_pb_level": F.lit(None).cast("int")})
        return none.join(binned, cond, how).drop(*helpers)
    rows = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("_times"))
    hit = meet(rows, "left_semi").distinct()
    again = lambda d: d.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*points.columns)
    if how == "left_semi":
        return again(hit)
    missed = again(null_safe_join(rows, hit.select(*points.columns), points.columns, "left_anti"))
    return meet(points, "inner").unionByName(missed, allowMissingColumns=True)


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    l_start: str,
    l_end: str,
    r_start: str,
    r_end: str,
    cap: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner join of half-open intervals that overlap. Every pair appears once.

    A pair overlaps where the later of the two starts lies in the other interval, so it is found by that start:
    starts of the left ask the index of the right, and starts of the right that of the left.
    """
    cond = (F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end))
    ordered = lambda d, a, b: d.where(F.col(a) <= F.col(b))

    def meet(points: DataFrame, t: str, intervals: DataFrame, start: str, end: str, more: Column) -> DataFrame:
        index = LengthClasses(intervals, start, end)
        binned = index.side(index.spread(intervals, start, end, "_ib"), cap)
        probes = index.probe(points, "_pb").withColumn("_pb", index.of(t, F.col("_pb_level")))
        same = (F.col("_pb") == F.col("_ib")) & (F.col("_pb_level") == F.col("_ib_level"))
        return probes.join(binned, same & cond & more).select(*left.columns, *right.columns)

    l, r = ordered(left, l_start, l_end), ordered(right, r_start, r_end)
    later_left = meet(l, l_start, r, r_start, r_end, F.col(l_start) >= F.col(r_start))
    return later_left.unionByName(meet(r, r_start, l, l_start, l_end, F.col(r_start) > F.col(l_start)))


def _running(rows: DataFrame, at: str, probes: list[DataFrame], weights: dict[str, Column]) -> DataFrame:
    """Totals of ``weights`` over the rows before each probe time: _p, and for each weight below_ (before),
    upto_ (before or at) and at_ (at). ``probes`` are one-column tables; every time is one row, so no pair arises."""
    own = rows.where(F.col(at).isNotNull()).groupBy(F.col(at).cast("double").alias("_p")).agg(*[F.sum(w).alias(c) for c, w in weights.items()])
    for p in probes:
        asked = p.select(F.col(p.columns[0]).cast("double").alias("_p")).where("_p IS NOT NULL").distinct()
        own = own.unionByName(asked.select("_p", *[F.lit(0).cast("long").alias(c) for c in weights]))
    steps = materialise(own.groupBy("_p").agg(*[F.sum(c).alias(c) for c in weights]), "running")
    r = prefix_sum(steps, [], "_p", list(weights))
    return r.select("_p", *[x for c in weights for x in ((F.col(f"cum_{c}") - F.col(c)).alias(f"below_{c}"), F.col(f"cum_{c}").alias(f"upto_{c}"), F.col(c).alias(f"at_{c}"))])


def _weights(sums: list[str]) -> dict[str, Column]:
    """Counts and totals, and how many values are not NULL: a total over NULLs alone is NULL."""
    out = {"_n": F.lit(1).cast("long")}
    for i, c in enumerate(sums):
        out |= {f"_s{i}": F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")), f"_c{i}": F.col(c).isNotNull().cast("long")}
    return out


def _totals(found: DataFrame, columns: list[str], sums: list[str], total) -> DataFrame:
    out = found.select(*columns, total("_n").alias("n"), *[F.when(total(f"_c{i}") > 0, total(f"_s{i}")).alias(c) for i, c in enumerate(sums)])
    return out.where("n > 0")


def interval_totals(points: DataFrame, intervals: DataFrame, t: str, start: str, end: str, sums: list[str], closed: bool = False) -> DataFrame:
    """For each interval that holds a point: its columns, the number ``n`` of points and totals of integer columns.

    The same numbers as an aggregate over ``interval_join``, from running totals at both ends, so the work
    grows with points and intervals and not with the pairs.
    """
    a, b = F.col(start), F.col(end)
    iv = intervals.where(a <= b if closed else a < b)
    r = materialise(_running(points, t, [iv.select(start), iv.select(end)], _weights(sums)), "totals")
    lo = r.select(F.col("_p").alias("_lo"), *[F.col(c).alias(f"lo{c}") for c in r.columns if c != "_p"])
    hi = r.select(F.col("_p").alias("_hi"), *[F.col(c).alias(f"hi{c}") for c in r.columns if c != "_p"])
    found = iv.join(lo, a.cast("double") == F.col("_lo")).join(hi, b.cast("double") == F.col("_hi"))
    return _totals(found, intervals.columns, sums, lambda c: F.col(f"hi{'upto' if closed else 'below'}_{c}") - F.col(f"lobelow_{c}"))


def overlap_totals(left: DataFrame, right: DataFrame, l_start: str, l_end: str, r_start: str, r_end: str, sums: list[str]) -> DataFrame:
    """For each right interval that a left one overlaps: its columns, the number ``n`` of left intervals and totals of
    integer columns of theirs; the same numbers as an aggregate over ``overlap_join``.

    Those that start before the right end, less those that end by its start. A left interval without length
    ends in no other one of that kind at the same time, so there it is not taken off.
    """
    l, r = left.where(F.col(l_start) <= F.col(l_end)), right.where(F.col(r_start) <= F.col(r_end))
    w = _weights(sums)
    empty = F.col(l_start) == F.col(l_end)
    points = {f"{c}_e": F.when(empty, x).otherwise(F.lit(0).cast("long")) for c, x in w.items()}
    begun = _running(l, l_start, [r.select(r_end)], w).select(F.col("_p").alias("_hi"), *[f"below_{c}" for c in w])
    over = _running(l, l_end, [r.select(r_start)], w | points).select(F.col("_p").alias("_lo"), *[f"upto_{c}" for c in w], *[f"at_{c}" for c in points])
    found = r.join(begun, F.col(r_end).cast("double") == F.col("_hi")).join(over, F.col(r_start).cast("double") == F.col("_lo"))
    same = F.col(r_start) == F.col(r_end)
    return _totals(found, right.columns, sums, lambda c: F.col(f"below_{c}") - F.col(f"upto_{c}") + F.when(same, F.col(f"at_{c}_e")).otherwise(F.lit(0).cast("long")))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    columns: list[str],
    by: list[str] | None = None,
    chunk: float = 86_400.0,
    forward: bool = False,
    tie: str | None = None,
    few: int = FEW_PROBES,
    strict: bool = False,
) -> DataFrame:
    """For each left row, ``columns`` of the last right row with time <= the left time.

    ``forward`` takes the first right row with time >= the left time. ``strict`` leaves out right rows
    at the left time itself. On equal right times the
    smallest ``tie`` value wins. With few probe times (checked) every right row is reduced to the
    probe it can serve before anything is shuffled. Otherwise time is cut into chunks of at most
    ``chunk``, shortened until no (key, chunk) is too full: a chunk is ordered on its own and receives
    the nearest row of the chunks before it, so no key is held in one task.
    """
    by = by or []
    sign = -1 if forward else 1
    key_r = (F.col(right_time) * sign).cast("double")
    tie_v = (-F.col(tie)).cast("double") if tie else F.lit(0.0)
    r = right.select(
        *by,
        key_r.alias("_t"),
        tie_v.alias("_tie"),
        F.struct(*[F.col(c) for c in columns]).alias("_payload"),
    ).where(F.col("_t").isNotNull())
    l = left.withColumn("_t", (F.col(left_time) * sign).cast("double"))
    probes = l.where(F.col("_t").isNotNull()).select("_t").distinct()
    if fits(probes, few):
        out = _asof_few(l, r, sorted(x[0] for x in probes.collect()), by, strict)
        return out.select(*[F.col(c) for c in left.columns], *[F.col("_hit")[c].alias(c) for c in columns])
    chunk = fitting_chunk(l.select(*by, "_t").unionByName(r.select(*by, "_t")), by, "_t", chunk)
    r = r.withColumn("_chunk", F.floor(F.col("_t") / chunk))
    l = l.withColumn("_chunk", F.floor(F.col("_t") / chunk))
    tails = r.groupBy(*by, "_chunk").agg(F.max_by("_payload", F.struct("_t", "_tie")).alias("_tail"))
    chunks = l.select(*by, "_chunk").unionByName(r.select(*by, "_chunk")).distinct()
    over = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = null_safe_join(chunks, tails, [*by, "_chunk"], "left").select(
        *by, "_chunk", F.last("_tail", ignorenulls=True).over(over).alias("_carry")
    )
    # Right rows sort before left rows of the same time (after them if strict), and later ties before earlier ones lose.
    mine, theirs = (0, 1) if strict else (1, 0)
    both = l.withColumn("_side", F.lit(mine)).withColumn("_tie", F.lit(0.0)).unionByName(
        r.withColumn("_side", F.lit(theirs)), allowMissingColumns=True
    )
    w = (
        Window.partitionBy(*by, "_chunk")
        .orderBy("_t", "_side", "_tie")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = both.withColumn("_hit", F.last("_payload", ignorenulls=True).over(w)).where(F.col("_side") == mine)
    out = null_safe_join(local, carry, [*by, "_chunk"], "left")
    pick = F.coalesce(F.col("_hit"), F.col("_carry"))
    return out.select(*[F.col(c) for c in left.columns], *[pick[c].alias(c) for c in columns])


def _asof_few(left: DataFrame, right: DataFrame, times: list[float], by: list[str], strict: bool = False) -> DataFrame:
    """As-of lookup for a short list of probe times: one map-side combined aggregate over ``right``."""
    n = 2
    while n - 1 < len(times):
        n *= 2
    top = 1.7976931348623157e308
    cuts = F.expr(f"array({', '.join(f'{float(x)!r}D' for x in times + [top] * (n - 1 - len(times)))})")
    slot = place_among("_t", cuts, n, at_or_below=strict)  # the first probe at or after the row, strictly after if strict
    placed = right.withColumn("_slot", slot).where(F.col("_slot") < len(times))
    # The latest time per probe by hash aggregation, then the payload of just those rows.
    latest = placed.groupBy(*by, "_slot").agg(F.max("_t").alias("_t"))
    winners = null_safe_join(placed, latest, [*by, "_slot", "_t"], "left_semi")
    best = winners.groupBy(*by, "_slot").agg(F.max_by("_payload", "_tie").alias("_best"))
    probe = left.withColumn("_slot", place_among("_t", cuts, n))
    slots = probe.select(*by, "_slot").unionByName(best.select(*by, "_slot")).distinct()
    w = Window.partitionBy(*by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)  # at most one row per probe time
    known = null_safe_join(slots, best, [*by, "_slot"]).select(*by, "_slot", F.last("_best", ignorenulls=True).over(w).alias("_hit"))
    return null_safe_join(probe, known, [*by, "_slot"])


def neighbour_row(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], time: str, chunk: float, forward: bool = False
) -> DataFrame:
    """lag (or lead, if ``forward``) of ``columns`` by one row per key, as ``adj_<c>``.

    Like ``asof_join`` it orders one time chunk at a time and passes the border row between
    neighbouring chunks, so a key with very many rows is still split. ``time`` leads ``order``.
    """
    chunk = fitting_chunk(df, keys, time, chunk)
    d = df.withColumn("_chunk", F.floor(F.col(time) / chunk))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    step = F.lead if forward else F.lag
    payload = F.struct(*[F.col(c) for c in columns])
    rank = F.struct(*[F.col(c) for c in order])
    d = d.withColumn("_adj", step(payload).over(w)).withColumn("_edge", step(F.lit(1)).over(w).isNull())
    pick = F.min_by if forward else F.max_by
    border = d.groupBy(*keys, "_chunk").agg(pick(payload, rank).alias("_b"))
    by_key = Window.partitionBy(*keys).orderBy("_chunk")
    border = border.select(*keys, "_chunk", step("_b").over(by_key).alias("_carry"))
    out = null_safe_join(d, border, [*keys, "_chunk"], "left")
    got = F.when(F.col("_edge"), F.col("_carry")).otherwise(F.col("_adj"))
    return out.select(*df.columns, *[got[c].alias(f"adj_{c}") for c in columns])
