"""Building blocks that keep global orderings and large groups spread over many tasks.

``prefix_sum`` gives running totals without a one-task window: each key's value range is cut into
buckets at approximate quantiles, bucket totals are accumulated (a few rows per key), and only the
rows of one bucket are ordered together. The cut points are data, so a recomputed task always
lands on the same bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise

# Groups up to this many rows may use an aggregate that buffers the whole group.
HOT_GROUP_ROWS = 500_000
# Largest table that is broadcast after its row count was checked.
BROADCAST_ROWS = 100_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join on same-named keys where NULL matches NULL; the right key columns are dropped."""
    if not keys:  # the right side is the single row of a global aggregate
        return left.crossJoin(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def fits(df: DataFrame, cap: int) -> bool:
    """Whether ``df`` has at most ``cap`` rows; reads no more than ``cap + 1`` of them."""
    return df.limit(cap + 1).count() <= cap


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Row count of the largest group (map-side combined, one small result row)."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def fitting_chunk(df: DataFrame, keys: list[str], time: str, chunk: float, hot_rows: int = HOT_GROUP_ROWS) -> float:
    """A time chunk small enough that no (key, chunk) holds more than ``hot_rows`` rows.

    The fullest chunk is measured and the length cut in proportion, until it fits or the rows share
    so few timestamps that shorter chunks no longer help.
    """
    last = None
    while True:
        n = largest_group(df.select(*keys, F.floor(F.col(time) / chunk).alias("_c")), [*keys, "_c"])
        if n <= hot_rows or (last is not None and n > 0.9 * last):
            return chunk
        last, chunk = n, chunk / (2 * -(-n // hot_rows))


def bucket_count(spark: SparkSession) -> int:
    """Number of value buckets: the next power of two above the shuffle parallelism."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n = 4
    while n < min(parts, 4096):
        n *= 2
    return n


def place_among(value: str, cuts: Column, n: int, at_or_below: bool = False) -> Column:
    """How many of the n - 1 sorted cut points (n a power of two) lie strictly below the value, or at or below it."""
    past = (lambda cut: F.col(value) >= cut) if at_or_below else (lambda cut: F.col(value) > cut)
    steps = []
    s = n // 2
    while s:
        steps.append(s)
        s //= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda acc, s: acc + F.when(past(F.element_at(cuts, acc + s)), s).otherwise(F.lit(0)),
    )


def prefix_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: list[str],
    descending: bool = False,
    with_next: bool = False,
    buckets: int | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Inclusive running totals per key in the order of a numeric column.

    ``df`` must hold one row per (keys, order value). Adds ``cum_<c>`` and ``tot_<c>`` for every
    column in ``sums``; ``with_next`` adds ``next_<order>``, the following value in ascending order.
    Keys measured (or known by the caller, ``small``) to hold at most ``HOT_GROUP_ROWS`` rows are
    ordered whole; otherwise every key is cut into value buckets.
    """
    if small is None:
        small = buckets is None and largest_group(df, keys) <= HOT_GROUP_ROWS
    if small:
        return _plain_prefix_sum(df, keys, order, sums, descending, with_next)
    n = buckets or bucket_count(df.sparkSession)
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(order, [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("_cuts")
    )
    placed = null_safe_join(df, cuts, keys, "inner").withColumn("_bucket", place_among(order, F.col("_cuts"), n)).drop("_cuts")
    totals = placed.groupBy(*keys, "_bucket").agg(
        *[F.sum(c).alias(f"_s_{c}") for c in sums], F.min(order).alias("_lowest")
    )
    by_key = Window.partitionBy(*keys)  # at most n rows per key
    before = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_bucket",
        *[F.sum(f"_s_{c}").over(before).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(by_key).alias(f"tot_{c}") for c in sums],
        F.lead("_lowest").over(by_key.orderBy("_bucket")).alias("_next_lowest"),
    )
    joined = null_safe_join(placed, offsets, [*keys, "_bucket"], "inner")
    local = Window.partitionBy(*keys, "_bucket").orderBy(order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    out = joined
    for c in sums:
        running = F.coalesce(F.col(f"_off_{c}"), F.lit(0)) + F.sum(c).over(upto)
        if descending:
            running = F.col(f"tot_{c}") - running + F.col(c)
        out = out.withColumn(f"cum_{c}", running)
    if with_next:
        out = out.withColumn(f"next_{order}", F.coalesce(F.lead(order).over(local), F.col("_next_lowest")))
    return out.drop("_bucket", "_next_lowest", *[f"_off_{c}" for c in sums])


def _plain_prefix_sum(df: DataFrame, keys: list[str], order: str, sums: list[str], descending: bool, with_next: bool) -> DataFrame:
    w = Window.partitionBy(*keys)
    by = F.col(order).desc() if descending else F.col(order)
    upto = w.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    new = {f"cum_{c}": F.sum(c).over(upto) for c in sums} | {f"tot_{c}": F.sum(c).over(w) for c in sums}
    if with_next:
        new[f"next_{order}"] = F.lead(order).over(w.orderBy(order))
    return df.withColumns(new)


def dense_position(df: DataFrame, keys: list[str], order: str, out: str = "pos", small: bool | None = None) -> DataFrame:
    """0-based row position per key in ``order`` (ties get consecutive positions), no global window.

    Returns one row per input row with columns keys, ``order`` and ``out``.
    """
    counts = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_sum(counts, keys, order, ["n"], small=small)
    return ranked.select(
        *keys, order, F.explode(F.sequence(F.col("cum_n") - F.col("n"), F.col("cum_n") - 1)).alias(out), F.col("tot_n").alias("n")
    )


def _rank(n: str, p: float, midpoint: bool) -> str:
    """0-based fractional rank: linear interpolation, or plotting positions (k - 0.5) / n."""
    return f"greatest(0D, least({n} - 1, {n} * {p!r}D - 0.5D))" if midpoint else f"(({n} - 1) * {p!r}D)"


def ranked_quantiles(
    df: DataFrame, keys: list[str], spec: dict[str, dict[str, float]], buckets: int | None = None, midpoint: bool = False
) -> DataFrame:
    """Exact interpolated quantiles by rank selection; no group is ever held in one task.

    ``spec`` maps value column -> {output name: probability}. NULLs are ignored.
    """
    cols = list(spec)
    long = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in cols])).alias("_x"),
    ).select(*keys, F.col("_x._c").alias("_c"), F.col("_x._v").alias("_v"))
    # The running totals read the counts several times: made once, the input is read and its values computed once.
    counts = materialise(long.where(F.col("_v").isNotNull()).groupBy(*keys, "_c", "_v").agg(F.count(F.lit(1)).alias("n")), "counts")
    ranked = prefix_sum(counts, [*keys, "_c"], "_v", ["n"], buckets=buckets)
    picks = []
    for c, names in spec.items():
        for name, p in names.items():
            h = F.expr(_rank("tot_n", float(p), midpoint))
            here = F.col("_c") == c
            for tag, r in (("lo", F.floor(h)), ("hi", F.ceil(h))):
                hit = here & (F.col("cum_n") > r) & (F.col("cum_n") - F.col("n") <= r)
                picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}_{name}"))
            picks.append(F.max(F.when(here, h - F.floor(h))).alias(f"_f_{name}"))
    wide = ranked.groupBy(*keys).agg(*picks)
    names = [n for s in spec.values() for n in s]
    return wide.select(
        *keys,
        *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in names],
    )


def sorted_lists(spec: dict[str, dict[str, float]]) -> list[Column]:
    """One sorted array per value column, for groups known to be small; feeds ``pick_quantiles``."""
    return [F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(f"_sorted_{c}") for c in spec]


def pick_quantiles(df: DataFrame, spec: dict[str, dict[str, float]], midpoint: bool = False) -> DataFrame:
    """Replace the sorted arrays by interpolated quantiles."""
    picked = []
    for c, names in spec.items():
        a = f"`_sorted_{c}`"
        for name, p in names.items():
            h = _rank(f"size({a})", float(p), midpoint)
            lo, hi = f"get({a}, cast(floor({h}) as int))", f"get({a}, cast(ceil({h}) as int))"
            picked.append(f"{lo} + ({hi} - {lo}) * ({h} - floor({h})) as `{name}`")
    keep = [f"`{c}`" for c in df.columns if c not in {f"_sorted_{v}" for v in spec}]
    return df.selectExpr(*keep, *picked)


def grouped_quantiles(
    df: DataFrame,
    keys: list[str],
    spec: dict[str, dict[str, float]],
    extra: list[Column] | None = None,
    hot_rows: int = HOT_GROUP_ROWS,
    small: bool | None = None,
    midpoint: bool = False,
) -> DataFrame:
    """Exact quantiles per group plus plain aggregates ``extra``.

    The largest group is measured first: small groups use the built-in aggregate in one shuffle,
    otherwise ranks are selected from distributed running counts. Both give the same numbers.
    """
    extra = extra or []
    if small or (small is None and largest_group(df, keys) <= hot_rows):
        return pick_quantiles(df.groupBy(*keys).agg(*extra, *sorted_lists(spec)), spec, midpoint)
    ranked = ranked_quantiles(df, keys, spec, midpoint=midpoint)
    if not extra:
        base = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
        return null_safe_join(base, ranked, keys, "left") if keys else ranked
    return null_safe_join(df.groupBy(*keys).agg(*extra), ranked, keys, "left")
