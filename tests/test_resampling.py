"""Bootstrap replicates against replicates drawn row by row."""

import hashlib

import numpy as np
import pytest

from wavegauge.operators import resampling as R
from wavegauge.operators import calibration as C
from wavegauge.operators.ranking import bootstrap_ap

REPS = 30


def plain_ap(score, label):
    p = int(label.sum())
    if p == 0 or p == len(label):
        return None
    cuts = np.unique(score)[::-1]
    total = 0.0
    for c in cuts:
        above = score >= c
        total += (label[score == c].sum()) * label[above].sum() / above.sum()
    return total / p


def rows(n=400, seed=0):
    g = np.random.default_rng(seed)
    label = (g.random(n) < 0.3).astype(int)
    score = np.round(g.normal(label, 1.0), 1)
    return score, label


def by_hand(score, label, rep, stratify):
    """One block: every draw is looked up in the sorted rows of its label."""
    ones, zeros = np.sort(score[label == 1]), np.sort(score[label == 0])
    n = len(score)
    take = len(ones) if stratify else sum(int(h < len(ones) / n * 2.0**32) for c in R.draws(rep, 2, 0, n) for h in c.tolist())
    s, y = [], []
    for stratum, own, m in ((1, ones, take), (0, zeros, n - take)):
        for c in R.draws(rep, stratum, 0, m):
            s += [own[h * len(own) >> 32] for h in c.tolist()]
        y += [stratum] * m
    return plain_ap(np.array(s), np.array(y))


@pytest.mark.parametrize("stratify", [True, False])
def test_one_block_equals_draws_row_by_row(spark, stratify):
    data, want = [], {}
    for key in (None, "a", "b"):
        score, label = rows(seed=len(want))
        data += [(key, float(s), int(y)) for s, y in zip(score, label)]
        want |= {(key, r): by_hand(score, label, r, stratify) for r in range(REPS)}
    df = spark.createDataFrame(data, "k string, score double, label int").repartition(5)
    got = {(r["k"], r["rep"]): r["ap"] for r in R.replicate_ap(df, ["k"], "score", "label", REPS, stratify).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


@pytest.mark.parametrize("stratify", [True, False])
def test_blocks_keep_sizes_and_spread(spark, stratify):
    """Many blocks, a third of all rows with one score: sizes as drawn, replicates spread as those of one block."""
    score, label = rows(3000, 3)
    score[:1000] = 0.4
    df = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "score double, label int")
    many = np.array([r["ap"] for r in R.replicate_ap(df, [], "score", "label", 400, stratify, block_rows=100).collect()])
    one = np.array([r["ap"] for r in R.replicate_ap(df, [], "score", "label", 400, stratify).collect()])
    assert len(many) == len(one) == 400
    spread = one.std()
    assert abs(many.mean() - one.mean()) < 0.3 * spread
    assert 0.8 < many.std() / spread < 1.25
    again = np.array([r["ap"] for r in R.replicate_ap(df.repartition(7), [], "score", "label", 400, stratify, block_rows=100).collect()])
    assert np.allclose(np.sort(many), np.sort(again), atol=1e-12)


def test_blocks_with_every_draw_given():
    counts = np.array([3, 0, 5, 1])
    got = R.step_counts(counts, 7, 1, 2, 1000)
    assert got.sum() == 1000 and got[1] == 0
    assert R.step_counts(np.array([9]), 7, 1, 2, 10**12).tolist() == [10**12]
    dealt = R._deal(3, 1, np.array([10, 0, 30]), 400)
    assert dealt.sum() == 400 and dealt[1] == 0


def test_edges(spark):
    schema = "k string, score double, label int, rep int, part double"
    empty = spark.createDataFrame([], schema)
    assert R.replicate_ap(empty.drop("rep"), ["k"], "score", "label", 5).count() == 0
    one_class = spark.createDataFrame([("x", 1.0, 1, 0, 0.0), ("x", None, 0, 0, 0.0), ("x", 2.0, None, 0, 0.0)], schema)
    out = R.replicate_ap(one_class, ["k"], "score", "label", 5).collect()
    assert len(out) == 5 and all(r["ap"] is None for r in out)
    ci = bootstrap_ap(one_class, ["k"], reps=5).collect()
    assert len(ci) == 1 and ci[0]["ap"] is None and ci[0]["n_valid"] == 0 and ci[0]["ci_low"] is None


@pytest.mark.parametrize("prefix", [b"", b"7|click|1|", b"x" * 43, b"y" * 60])
@pytest.mark.parametrize("block", [0, 1, 4321])
@pytest.mark.parametrize("most", [3, 1001, R.HASHED])
def test_md5_heads(prefix, block, most):
    lo = block * R.HASHED
    want = [int(hashlib.md5(prefix + b"%d" % j).hexdigest()[:8], 16) for j in range(lo, lo + most)]
    assert R.md5_heads(prefix, block, most).tolist() == want


@pytest.mark.parametrize("cap", [None, 25])
def test_ks_bootstrap_counts_equal_joined_draws(spark, monkeypatch, cap):
    g = np.random.default_rng(5)
    rows = [(k, float(v), int(a)) for k, n in (("a", 80), (None, 45), ("few", 12)) for v, a in zip(np.round(g.normal(0, 1, n), 1), g.random(n) < 0.4)]
    rows += [("a", float("nan"), 1), ("a", float("inf"), 0), ("a", None, 0)]
    df = spark.createDataFrame(rows, "g string, v double, a int")
    shared = sorted(map(tuple, C.ks_bootstrap(df, ["g"], "v", "a", 20, cap).collect()), key=str)
    monkeypatch.setattr(C, "SHARED_STEPS", 0)
    assert shared == sorted(map(tuple, C.ks_bootstrap(df, ["g"], "v", "a", 20, cap).collect()), key=str)


def test_ks_bootstrap_shuffles_no_draws(spark, monkeypatch):
    df = spark.range(2000).selectExpr("id % 2 as g", "cast(id % 7 as double) as v", "cast(id % 3 = 0 or id % 2 = 1 as int) as a")  # key 1 has one side

    def never(*_, **__):
        raise AssertionError("draws as rows")

    monkeypatch.setattr(C, "resample_positions", never)
    got = {r["g"]: r["ks_ci_hi"] for r in C.ks_bootstrap(df, ["g"], "v", "a", 10).collect()}
    assert got[0] > 0 and got[1] is None
