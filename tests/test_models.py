import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavegauge.operators import adaptive as A
from wavegauge.operators import inverse as I
from wavegauge.operators import ranking as M
from wavegauge.operators import scorers as S
from wavegauge.operators import surrogate as G


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, (600, 3))
    x = np.c_[base, base @ rng.normal(0, 1, (3, 5)) + rng.normal(0, 0.1, (600, 5))]
    x[560:] += rng.normal(0, 6, (40, 8))
    d = pd.DataFrame(x, columns=[f"f{k}" for k in range(8)]).assign(id=np.arange(600), y=(np.arange(600) >= 560).astype(int))
    d.loc[5, "f1"] = None
    d["empty"] = None
    d["empty"] = d["empty"].astype(float)
    return spark.createDataFrame(d).withColumn("empty", F.lit(None).cast("double")).cache()


@pytest.mark.parametrize("name", list(S.BENCHMARK))
def test_scorers_rank_outliers(cloud, name):
    cols = [f"f{k}" for k in range(8)] + ["empty"]
    m = S.BENCHMARK[name](cols, ["id"]).fit(cloud.where("y = 0"))
    r = M.ranking_metrics(m.score(cloud), [], "score", "y").first()
    assert r["roc_auc"] > 0.9, r


def test_preprocess_is_train_only(cloud):
    p = S.Preprocessor(["f1", "empty"]).fit(cloud.where("y = 0"))
    x = cloud.where("y = 0").toPandas()["f1"]
    f = x.fillna(x.median())
    assert p.empty == ["empty"] and np.isclose(p.median[0], x.median()) and np.isclose(p.mean[0], f.mean()) and np.isclose(p.std[0], f.std(ddof=0))


def test_pca_matches_svd(cloud):
    cols = [f"f{k}" for k in range(8)]
    train = cloud.where("y = 0")
    got = S.PcaScorer(cols, ["id"]).fit(train).score(cloud).select("id", "score").toPandas().sort_values("id")
    t = train.toPandas()[cols]
    z = lambda d: ((d[cols].fillna(t.median()) - t.fillna(t.median()).mean()) / t.fillna(t.median()).std(ddof=0)).to_numpy()
    v = np.linalg.svd(z(t), full_matrices=False)[2][:5].T
    a = z(cloud.toPandas().sort_values("id"))
    assert np.allclose(got["score"], ((a - a @ v @ v.T) ** 2).mean(1), atol=1e-8)


def test_knn_paths_agree(cloud):
    t = cloud.where("y = 0").select("id", F.array(*[F.coalesce(F.col(f"f{k}"), F.lit(0.0)) for k in range(8)]).alias("x"))
    a = S.nearest_neighbours(t, t, 5, skip_self=True).toPandas().sort_values(["qid", "dist", "nid"]).reset_index(drop=True)
    b = S.nearest_neighbours(t, t, 5, skip_self=True, cap=0).toPandas().sort_values(["qid", "dist", "nid"]).reset_index(drop=True)
    assert (a["nid"] == b["nid"]).all() and np.allclose(a["dist"], b["dist"])


def test_average_precision_ties_and_one_class(spark):
    d = spark.createDataFrame([("a", 0.9, 1), ("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.1, 0), ("b", 0.3, 1)], "g string, score double, label int")
    got = {r["g"]: r for r in M.ranking_metrics(d, ["g"]).collect()}
    assert np.isclose(got["a"]["ap"], 0.5 * 1 + 0.5 * 2 / 3) and got["a"]["roc_auc"] == 0.875
    assert got["b"]["ap"] is None and got["b"]["n_pos"] == 1


def test_folds_keep_configs_together(spark):
    rows = [(float(t), float(h), 0.0, s) for t in (256, 480, 1024) for h in range(4) for s in range(5)]
    f = G.grouped_folds(spark.createDataFrame(rows, "ttt_ms double, hyst_db double, a3_off_db double, seed int"), 5)
    assert f.groupBy(*G.CONTROLLED).agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 5
    with pytest.raises(ValueError):
        G.grouped_folds(f.drop("fold"), 13)


def test_conformal_covers(spark):
    rng = np.random.default_rng(2)
    d = pd.DataFrame({c: rng.normal(0, 1, 900) for c in G.CONTEXT}).assign(ttt_ms=rng.choice([256.0, 480.0], 900), hyst_db=rng.choice([0.0, 2.0], 900), a3_off_db=0.0, seed=np.arange(900))
    d["hosr"] = 0.5 + 0.1 * d["hyst_db"] + rng.normal(0, 0.2, 900)
    s = spark.createDataFrame(d)
    m = G.ConformalForest(0.1, 0.9, trees=8).fit(s.where("seed < 600"), "hosr")
    out = m.predict_interval(s.where("seed >= 600").withColumn("actual", F.col("hosr"))).toPandas()
    assert ((out.hosr_lo <= out.hosr) & (out.hosr <= out.hosr_hi)).all()
    assert 0.70 <= ((out.actual >= out.hosr_lo) & (out.actual <= out.hosr_hi)).mean() <= 0.95
    with pytest.raises(ValueError):
        G.ConformalForest().fit(s.limit(10), "hosr")


def test_inverse_query_rules(spark):
    ctx = spark.createDataFrame([(1, *[float(k) for k in range(9)])], "context_id int, " + ", ".join(f"{c} double" for c in G.CONTEXT))
    sur = G.ExpressionSurrogate({"hosr": "1 - hyst_db / 10", "rlf_rate": "ttt_ms / 10000", "ping_pong_rate": "0.1D"})
    out = I.inverse_query(ctx, G.candidate_grid(spark), sur, [I.Constraint("rlf_rate", "<", 0.048)]).toPandas()
    assert len(out) == 36 and out.feasible.sum() == 12 == out.n_feasible.iloc[0]
    top = out.sort_values("rank").iloc[0]
    assert (top.ttt_ms, top.hyst_db, top.feasible) == (256.0, 0.0, True)
    with pytest.raises(ValueError):
        I.Constraint("hosr", "==", 1)
    with pytest.raises(ValueError):
        I.inverse_query(ctx.drop("rsrp_p10_dbm"), G.candidate_grid(spark), sur)
    with pytest.raises(ValueError):
        I.inverse_query(ctx, G.candidate_grid(spark), sur, [I.Constraint("x", "<", 1)])


@pytest.mark.parametrize("cap", [100_000, 3])
def test_pareto_brute(spark, cap):
    rng = np.random.default_rng(7)
    p = rng.integers(0, 15, (300, 2)).astype(float)
    keep = [i for i, (a, b) in enumerate(p) if not any(x >= a and y <= b and (x > a or y < b) for x, y in p)]
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "i int, a double, b double")
    assert sorted(r["i"] for r in I.pareto_front(d, [("a", "max"), ("b", "min")], cap).collect()) == keep


def _windows(spark, n=200):
    rng = np.random.default_rng(0)
    rows = [(i, 1 if i < 60 else 4, float(i), float(i) + 5, float(i) + 2.5, int(i % 40 == 0), *rng.normal(0, 1, 4).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id int, phase_id int, t_start_s double, t_end_s double, t_mid_s double, label_anomaly int, a double, b double, c double, d double")


COLS = ["a", "b", "c", "d"]


def test_periodic_paths_agree(spark, monkeypatch):
    w = _windows(spark).where("phase_id > 3")
    a = [r["t_s"] for r in A.Periodic(30.0).epochs(w, None).collect()]
    monkeypatch.setattr(A, "HOT_GROUP_ROWS", 0)
    b = [r["t_s"] for r in A.Periodic(30.0).epochs(w, None).collect()]
    assert a == b == [95.0, 125.0, 155.0, 185.0]


def test_cooldown_loses_signals(spark):
    s = spark.createDataFrame([(10.0, ["b", "a"]), (20.0, ["a"]), (45.0, ["c"]), (46.0, ["a"])], "t_s double, streams array<string>")
    got = [(r["t_s"], r["reason"]) for r in A.DriftTriggered(30.0).epochs(s, s).collect()]
    assert got == [(10.0, "drift:a,b"), (45.0, "drift:c")]
    assert [r["t_s"] for r in A.DriftTriggered(30.0, ["a"]).epochs(s, s).collect()] == [10.0, 46.0]


def _replay(spark, w, f, **kw):
    return A.replay(w, f, A.DriftTriggered(20.0), S.PcaScorer, COLS, ["id"], pool_window=40.0, **kw)


def test_replay_is_causal(spark):
    w = _windows(spark)
    f = spark.createDataFrame([("s", "x", 90.0), ("s", "x", 140.0), ("s", "x", 150.0)], "stream_name string, detector string, time_s double")
    full, log = _replay(spark, w, f)
    cut, _ = _replay(spark, w, f.where("time_s < 120"))
    a, b = (x.where("t_end_s < 140").select("id", "score").toPandas().sort_values("id") for x in (full, cut))
    assert np.allclose(a["score"], b["score"])
    got = [(r["t_s"], r["reason"], r["n_train_samples"]) for r in log.collect()]
    assert [g[1] for g in got] == ["warmup", "drift:s", "drift:s"] and got[1][0] == 90.0 and got[1][2] == 40
    later = full.where("t_end_s > 150").select("score").toPandas()["score"], cut.where("t_end_s > 150").select("score").toPandas()["score"]
    assert not np.allclose(*later)


def test_filtered_pool_and_empty_pool(spark):
    w = _windows(spark)
    f = spark.createDataFrame([("s", "x", 120.0)], "stream_name string, detector string, time_s double")
    _, log = _replay(spark, w, f, filter_quantile=0.8)
    r = log.where("reason = 'drift:s'").first()
    assert r["n_train_samples_pre_filter"] == 40 and r["n_train_samples"] == 32

    class Early(A.Strategy):
        name = "early"

        def epochs(self, decisions, signals):
            return spark.createDataFrame([(-500.0, "drift:s")], A.EPOCH_SCHEMA)

    scored, log = A.replay(w, f, Early(), S.PcaScorer, COLS, ["id"], pool_window=10.0)
    assert log.where("reason = 'drift:s_skip_empty'").count() == 1 and scored.where("score IS NULL").count() == 0


def test_hash_sample_is_exact_and_stable(spark):
    d = spark.range(5000).withColumnRenamed("id", "k")
    h = d.withColumn("h", F.xxhash64(F.lit(42), "k")).orderBy("h", "k").limit(100)
    a = {r["k"] for r in S.hash_sample(d.repartition(13), ["k"], 100).collect()}
    assert a == {r["k"] for r in h.collect()} and len(a) == 100
    assert S.hash_sample(d, ["k"], 6000).count() == 5000


@pytest.mark.parametrize("name", ["IsoForest", "OneClassSVM", "MLP-AE"])
def test_scores_do_not_depend_on_the_layout(cloud, name):
    cols = [f"f{k}" for k in range(8)]
    scores = []
    for parts in (1, 7):
        m = S.BENCHMARK[name](cols, ["id"]).fit(cloud.repartition(parts).where("y = 0"))
        scores.append(m.score(cloud).select("id", "score").toPandas().sort_values("id")["score"].to_numpy())
    assert np.allclose(*scores, rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("name", list(S.BENCHMARK))
def test_replay_with_every_scorer(spark, name):
    w = _windows(spark)
    f = spark.createDataFrame([("s", "x", 90.0), ("s", "x", 140.0)], "stream_name string, detector string, time_s double")
    scored, log = A.replay(w, f, A.DriftTriggered(20.0), S.BENCHMARK[name], COLS, ["id"], pool_window=40.0)
    assert scored.count() == w.where("phase_id > 3").count() and log.count() > 1
    assert scored.where("score IS NULL").count() == 0


@pytest.mark.parametrize("bad", [{"columns": []}, {"pool_window": 0.0}, {"filter_quantile": 1.0}, {"filter_quantile": 0.0}])
def test_replay_checks_its_arguments(spark, bad):
    args = {"columns": COLS, "key": ["id"], "pool_window": 40.0, **bad}
    with pytest.raises(ValueError):
        A.replay(None, None, A.Static(), S.PcaScorer, **args)


@pytest.mark.parametrize("skip_self", [False, True])
@pytest.mark.parametrize("n, shift", [(300, 0.0), (300, 1e8), (4, 0.0)])
def test_nearest_equals_full_ordering(n, shift, skip_self, monkeypatch):
    """Ties, copies and values far from zero, where products round coarsely; few rows are compared one by one."""
    g = np.random.default_rng(3)
    t = np.round(g.normal(0, 1, (n, 6)), 1) + shift
    t[n // 2 :] = t[: n - n // 2]
    t_id = g.permutation(n) + 10
    q, q_id = t[:50], t_id[:50]
    d2 = np.zeros((len(q), n))
    for j in range(6):
        d2 += (q[:, j, None] - t[None, :, j]) ** 2
    if skip_self:
        d2[q_id[:, None] == t_id] = np.inf
    by = np.lexsort((np.broadcast_to(t_id, d2.shape), d2))[:, :5]
    monkeypatch.setattr(S, "CELLS", 7 * n)
    ids, dist = S._nearest(q, q_id, t, t_id, 5, skip_self)
    assert (ids == t_id[by]).all() and (dist == np.sqrt(np.take_along_axis(d2, by, 1))).all()


def test_nearest_orders_only_rows_that_may_be_near(monkeypatch):
    g = np.random.default_rng(4)
    t, sizes, plain = g.normal(0, 1, (3000, 16)), [], np.lexsort

    def seen(keys):
        sizes.append(np.size(keys[-1]))
        return plain(keys)

    monkeypatch.setattr(S.np, "lexsort", seen)
    S._nearest(t[:100], np.arange(100), t, np.arange(3000), 20, True)
    assert sum(sizes) <= 100 * 25


def test_conformal_margin_computes_residuals_once(spark):
    n = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        n.add(1)
        return x

    d = spark.range(300).select(F.col("id").cast("double").alias("y"), F.lit(100.0).alias("lo"), F.lit(200.0).alias("hi")).withColumn("y", seen.asNondeterministic()("y"))
    assert G.conformal_margin(d, "y", "lo", "hi", 0.8).first()["n_calibration"] == 300
    assert n.value == 300
