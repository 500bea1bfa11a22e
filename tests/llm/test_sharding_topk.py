import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from wavegauge.llm import topk
from wavegauge.llm.sharding import shard_documents


def jump(key, shards):
    k = int(hashlib.md5(str(key).encode()).hexdigest()[:8], 16) % (2**31 - 2) + 1
    b = j = 0
    while j < shards:
        b, k = j, k * 48271 % (2**31 - 1)
        j = int((b + 1) * float(2**31 - 1) / k)
    return b


def test_jump_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = shard_documents(docs, 24).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(got) == len(text)
    for r in got:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["shard"], r["grown_shard"]) == (jump(r["doc_id"], 24), jump(r["doc_id"], 25))
        assert r["grown_shard"] in (r["shard"], 24)
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"


def test_shards_of_odd_tables(edge, nothing):
    got = shard_documents(edge, 5, slices=3).collect()
    assert len(got) == edge.count()
    per = Counter(r["shard"] for r in got)
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((s, i) for s, n in per.items() for i in range(n))
    assert {r["size"] for r in got if r["doc_id"] == 0} == {8}
    assert shard_documents(nothing).count() == 0
    with pytest.raises(ValueError):
        shard_documents(nothing, 0)


def test_sharding_plan_is_native(edge):
    plan = shard_documents(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute(ids, vectors, every, k):
    out = []
    ok = [i for i, v in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v) and ids[i] is not None]
    for q in sorted({i for i in ok if ids[i] % every == 0}):
        best = {}
        for c in ok:
            if ids[c] != ids[q]:
                s = sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(vectors[q], vectors[c]))
                best[ids[c]] = max(best.get(ids[c], -(2**70)), max(-(2**63), min(2**63 - 1, s)))
        out += [(ids[q], r, v, s) for r, (v, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(set(out))


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = [[float(x) for x in np.round(r, 2)] for r in rng.normal(size=(300, 40))]
    v += [v[0], v[1], v[7], None, [], [float("nan")] * 40, [float("inf")] * 40, [None] * 40, [1e17] * 40, [0.5, 0.25]]
    ids = [*range(len(v) - 1), 10]  # 10 comes twice
    df = spark.createDataFrame([(i, x, "a", 0) for i, x in zip(ids, v)] + [(None, v[0], "a", 0)], "vec_id long, embedding array<double>, query_id string, score int")
    for part in (df, df.where("vec_id not between 308 and 308")):
        data = [(r["vec_id"], r["embedding"]) for r in part.collect()]
        got = sorted(map(tuple, topk.exact_topk(part, 50, query_block=3, candidate_block=100).collect()))
        want = brute([i for i, _ in data], [x for _, x in data], 50, 5)
        assert got == want
    assert topk.exact_topk(df.limit(0)).count() == 0
    assert topk.exact_topk(df.where("vec_id % 50 <> 0")).count() == 0


def test_branch_and_bound_tiles(monkeypatch):
    monkeypatch.setattr(topk, "TILE", 64)
    rng = np.random.default_rng(5)
    c = np.floor(256 * rng.normal(size=(500, 50)) * np.linspace(3, 0.1, 50))
    ids = np.arange(500)
    got = list(topk.search(ids[:20], c[:20], ids, c, 5))
    for i in range(20):
        s = c @ c[i]
        best = sorted((j for j in range(500) if j != i), key=lambda j: (-s[j], j))[:5]
        assert [(x[1], x[2]) for x in got if x[0] == i] == [(j, int(s[j])) for j in best]
