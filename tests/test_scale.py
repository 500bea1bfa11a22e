"""The distributed paths must give the same numbers as the plain ones, whatever the partitioning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavegauge.operators import joins as J
from wavegauge.operators import scale as S


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    # One key holds most of the rows and has heavy ties.
    g = np.where(rng.random(4000) < 0.7, "hot", rng.choice(list("abc"), 4000))
    v = np.where(g == "hot", np.round(rng.normal(0, 3, 4000), 1), rng.normal(50, 9, 4000))
    return spark.createDataFrame(pd.DataFrame({"g": g, "v": v})).repartition(7)


def test_prefix_sum_buckets_match_pandas(values):
    d = values.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for desc in (False, True):
        got = S.prefix_sum(d, ["g"], "v", ["n"], descending=desc, with_next=True, buckets=16).toPandas()
        want = values.toPandas().groupby(["g", "v"]).size().rename("n").reset_index().sort_values("v", ascending=not desc)
        want["cum"] = want.groupby("g")["n"].cumsum()
        m = got.merge(want, on=["g", "v"])
        assert (m["cum_n"] == m["cum"]).all() and len(m) == len(want)
    asc = want.sort_values("v")
    asc["nxt"] = asc.groupby("g")["v"].shift(-1)
    m = got.merge(asc, on=["g", "v"])
    assert np.allclose(m["next_v"].astype(float), m["nxt"], equal_nan=True)


def test_ranked_quantiles_match_numpy(values):
    spec = {"v": {"a": 0.1, "b": 0.5, "c": 0.93}}
    got = S.ranked_quantiles(values, ["g"], spec, buckets=8).toPandas().set_index("g")
    for g, x in values.toPandas().groupby("g")["v"]:
        assert np.allclose(got.loc[g, ["a", "b", "c"]].astype(float), np.quantile(x, [0.1, 0.5, 0.93]))


def test_grouped_quantiles_hot_path_equal(values):
    spec = {"v": {"p": 0.37}}
    a = S.grouped_quantiles(values, ["g"], spec, [F.count(F.lit(1)).alias("n")], hot_rows=10).toPandas().sort_values("g")
    b = S.grouped_quantiles(values, ["g"], spec, [F.count(F.lit(1)).alias("n")]).toPandas().sort_values("g")
    assert np.allclose(a["p"], b["p"]) and (a["n"].values == b["n"].values).all()


def test_null_keys_survive(spark):
    d = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", 5.0)], "g string, v double")
    got = {r["g"]: r["p"] for r in S.grouped_quantiles(d, ["g"], {"v": {"p": 0.5}}, [F.count(F.lit(1)).alias("n")], hot_rows=0).collect()}
    assert got == {None: 2.0, "x": 5.0}


def _brute(points, intervals, closed):
    hit = lambda t, a, b: a <= t <= b if closed else a <= t < b
    return sorted((t, a, b) for t in points for a, b in intervals if hit(t, a, b))


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("cap", [100, 0])
def test_interval_join_paths(spark, closed, cap):
    rng = np.random.default_rng(3)
    pts = [round(float(x), 1) for x in rng.uniform(0, 50, 300)]
    iv = [(round(float(a), 1), round(float(a + w), 1)) for a, w in zip(rng.uniform(0, 50, 40), rng.uniform(0, 6, 40))]
    p, i = spark.createDataFrame([(x,) for x in pts], "t double"), spark.createDataFrame(iv, "a double, b double")
    got = sorted(tuple(r) for r in J.interval_join(p, i, "t", "a", "b", closed=closed, cap=cap).collect())
    assert got == _brute(pts, iv, closed)


@pytest.mark.parametrize("cap", [100, 0])
def test_overlap_join_paths(spark, cap):
    rng = np.random.default_rng(4)
    mk = lambda n: [(round(float(a), 1), round(float(a + w), 1)) for a, w in zip(rng.uniform(0, 40, n), rng.uniform(0.1, 9, n))]
    l, r = mk(60), mk(30)
    got = sorted(tuple(x) for x in J.overlap_join(spark.createDataFrame(l, "w0 double, w1 double"), spark.createDataFrame(r, "a0 double, a1 double"), "w0", "w1", "a0", "a1", cap=cap).collect())
    assert got == sorted((*x, *y) for x in l for y in r if x[0] < y[1] and y[0] < x[1])


def test_interval_joins_are_equi_joins(spark):
    p, i = spark.createDataFrame([(1.0,), (50.0,), (None,)], "t double"), spark.createDataFrame([(0.0, 2.0), (40.0, float("inf")), (9.0, 3.0), (None, 1.0)], "a double, b double")
    w = p.select("t", (p.t + 1).alias("u"))
    for cap in (0, 100):
        for df in (J.interval_join(p, i, "t", "a", "b", cap=cap), J.interval_join(p, i, "t", "a", "b", how="left_semi", cap=cap), J.overlap_join(w, i, "t", "u", "a", "b", cap=cap)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
            assert sorted(r["t"] for r in df.collect()) == [1.0, 50.0]
        assert J.interval_join(p, i, "t", "a", "b", how="left", cap=cap).count() == 3
        assert J.interval_join(p, i.limit(0), "t", "a", "b", cap=cap).count() == 0


@pytest.mark.parametrize("cap", [10_000, 0])
def test_one_long_interval_does_not_widen_the_bins_of_short_ones(spark, cap):
    """400 short intervals and one of 10^6 s: candidate pairs stay in proportion to the matches."""
    iv = [(i * 10.0, i * 10.0 + 0.001) for i in range(400)] + [(0.0, 1e6), (-float("inf"), 15.0)]
    pts = [i * 10.0 + 0.0005 for i in range(400)] + [2e6, -5.0, None]
    p, i = spark.createDataFrame([(x, k) for k, x in enumerate(pts)], "t double, k long"), spark.createDataFrame(iv, "a double, b double")
    index = J.LengthClasses(i, "a", "b")
    assert index.levels == [-9, 4, 20]
    binned, probes = index.spread(i, "a", "b", "ib"), index.probe(p, "pb").withColumn("pb", index.of("t", F.col("pb_level")))
    assert binned.count() <= 2 * len(iv) + 2 and probes.count() == len(pts) * len(index.levels)
    met = probes.join(binned, (F.col("pb") == F.col("ib")) & (F.col("pb_level") == F.col("ib_level"))).count()
    want = [(x, a, b) for x in pts if x is not None for a, b in iv if a <= x < b]
    assert met <= 3 * len(want)
    assert sorted((r["t"], r["a"], r["b"]) for r in J.interval_join(p, i, "t", "a", "b", cap=cap).collect()) == sorted(want)
    semi = J.interval_join(p.unionAll(p), i, "t", "a", "b", how="left_semi", cap=cap).collect()
    assert sorted(r["t"] for r in semi) == sorted(2 * [x for x in pts if x is not None and x < 1e6])
    left = J.interval_join(p, i, "t", "a", "b", how="left", cap=cap).collect()
    assert sum(r["a"] is None for r in left) == 2 and len(left) == len(want) + 2
    w = p.select("t", (p.t + 20).alias("u"))
    got = sorted((r["t"], r["a"]) for r in J.overlap_join(w, i, "t", "u", "a", "b", cap=cap).collect())
    assert got == sorted((x, a) for x in pts if x is not None for a, b in iv if x < b and a < x + 20)


@pytest.mark.parametrize("few", [0, 10])
@pytest.mark.parametrize("base", [0.0, 1704067200.0])
def test_strict_asof_leaves_out_equal_times(spark, few, base):
    l = spark.createDataFrame([(base + 5.0,), (base + 1.0,), (base + 9.0,)], "t double")
    r = spark.createDataFrame([(base + 4.0, 1), (base + 5.0, 2), (base + 6.0, 3), (base + 1.0, 0)], "u double, v long")
    for forward, want in ((False, {5.0: 1, 1.0: None, 9.0: 3}), (True, {5.0: 3, 1.0: 1, 9.0: None})):
        got = J.asof_join(l, r, "t", "u", ["v"], forward=forward, few=few, strict=True).collect()
        assert {x["t"] - base: x["v"] for x in got} == want


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("chunk, few", [(3.0, 0), (1e6, 0), (1e6, 4095)])
def test_asof_join_matches_pandas(spark, forward, chunk, few):
    rng = np.random.default_rng(5)
    l = pd.DataFrame({"k": rng.integers(0, 3, 200), "t": np.round(rng.uniform(0, 100, 200), 2)})
    r = pd.DataFrame({"k": rng.integers(0, 3, 60), "u": np.round(rng.uniform(0, 100, 60), 2), "id": np.arange(60)})
    got = J.asof_join(spark.createDataFrame(l), spark.createDataFrame(r), "t", "u", ["id", "u"], by=["k"], chunk=chunk, forward=forward, few=few).toPandas()
    want = pd.merge_asof(l.sort_values("t"), r.sort_values("u"), left_on="t", right_on="u", by="k", direction="forward" if forward else "backward")
    a, b = (x.sort_values(["k", "t"]).reset_index(drop=True) for x in (got, want))
    assert len(a) == len(b) and np.allclose(a["id"].astype(float), b["id"], equal_nan=True)


@pytest.mark.parametrize("few", [0, 10])
def test_asof_tie_takes_smallest(spark, few):
    l = spark.createDataFrame([(5.0,)], "t double")
    r = spark.createDataFrame([(5.0, 2, "b"), (5.0, 1, "a"), (4.0, 0, "z")], "u double, id long, v string")
    assert J.asof_join(l, r, "t", "u", ["v"], tie="id", few=few).first()["v"] == "a"


def test_neighbour_row_across_chunks(spark):
    rows = [(k, float(t), t) for k in range(2) for t in (0, 1, 7, 8, 30, 31, 64)]
    d = spark.createDataFrame(rows, "k long, t double, v long")
    lag = {(r["k"], r["v"]): r["adj_v"] for r in J.neighbour_row(d, ["k"], ["t"], ["v"], "t", 5.0).collect()}
    lead = {(r["k"], r["v"]): r["adj_v"] for r in J.neighbour_row(d, ["k"], ["t"], ["v"], "t", 5.0, forward=True).collect()}
    order = [0, 1, 7, 8, 30, 31, 64]
    for k in range(2):
        assert [lag[k, v] for v in order] == [None, *order[:-1]]
        assert [lead[k, v] for v in order] == [*order[1:], None]


def test_chunks_shrink_for_full_keys(spark):
    d = spark.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") / 10).alias("t"))
    c = S.fitting_chunk(d, ["k"], "t", 1000.0, hot_rows=20)
    assert S.largest_group(d.select("k", F.floor(F.col("t") / c).alias("c")), ["k", "c"]) <= 20
    same = d.withColumn("t", F.lit(1.0))
    assert S.fitting_chunk(same, ["k"], "t", 10.0, hot_rows=20) > 0


INF = float("inf")


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("small", [True, False])
def test_interval_totals_equal_the_aggregated_join(spark, closed, small, monkeypatch):
    from wavegauge.operators import scale

    if not small:
        monkeypatch.setattr(scale, "HOT_GROUP_ROWS", 5)
    p = spark.createDataFrame([(1.0, 5), (1.0, None), (2.5, 7), (4.0, -3), (9.0, None), (INF, 2), (-INF, 3), (None, 4)], "t double, k int")
    i = spark.createDataFrame([(1, 1.0, 2.5), (2, 2.5, 2.5), (3, 4.0, 1.0), (4, 0.0, 4.0), (4, 0.0, 4.0), (5, 8.0, 9.5), (6, -INF, INF), (7, None, 3.0), (8, 20.0, 30.0)], "a int, t0 double, t1 double")
    want = J.interval_join(p, i, "t", "t0", "t1", closed=closed).groupBy("a").agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    got = J.interval_totals(p, i, "t", "t0", "t1", ["k"], closed=closed).groupBy("a").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_overlap_totals_equal_the_aggregated_join(spark):
    ends = [(0.0, 2.0), (1.0, 1.0), (1.0, 1.0), (2.0, 2.0), (1.0, 4.0), (3.0, 2.0), (-INF, INF), (None, 1.0), (2.0, 5.0)]
    l = spark.createDataFrame([(b, *x) for b, x in enumerate(ends)], "b long, w0 double, w1 double")
    r = spark.createDataFrame([(a, *x) for a, x in enumerate(ends)], "a long, t0 double, t1 double")
    want = J.overlap_join(l, r, "w0", "w1", "t0", "t1").groupBy("a").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    got = J.overlap_totals(l, r, "w0", "w1", "t0", "t1", ["b"]).select("a", "n", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["j02_interval_join_binned", "j02_overlap_join_binned"])
def test_interval_queries_make_no_pairs(spark, sf, monkeypatch, name):
    import __spark_entry__ as entry

    def never(*_, **__):
        raise AssertionError("pairs")

    monkeypatch.setattr(J, "interval_join", never)
    monkeypatch.setattr(J, "overlap_join", never)
    assert entry.queries()[name](spark, sf).count() > 0
