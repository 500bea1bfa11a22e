import random
import re
from collections import Counter

import numpy as np
import pytest

from wavegauge.llm import minhash, pivots
from wavegauge.llm.components import connected_components
from wavegauge.llm.minhash import near_duplicates
from wavegauge.llm.pivots import near_vectors

from .conftest import rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, percent=80):
    sets = [(i, shingle_set(t, k)) for i, t in docs]
    links = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                links.append((i, j))
    return sets, components({i for i, _ in docs if i is not None}, links)


def check(df, k):
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    sets, want = brute(docs, k)
    got = near_duplicates(df, k=k).collect()
    assert sorted(((r["doc_id"], r["n_shingles"]) for r in got), key=repr) == sorted(((i, len(s)) for i, s in sets), key=repr)
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"]), r
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
    return want


def noisy_group(rng, base, n, edits):
    return [" ".join(rng.choice("xyz") + str(rng.random()) if rng.random() < edits else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(make, k):
    rng = random.Random(k)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = noisy_group(rng, base, 40, 0.02) + noisy_group(rng, base, 20, 0.06) + [" ".join(base)] * 5
    texts += [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [" ".join(base[:60]) + " " + " ".join(f"v{rng.randrange(900)}" for _ in range(60)) for _ in range(30)]
    want = check(make(rows(*texts, first=100)), k)
    assert max(Counter(want.values()).values()) > 20


def test_near_duplicates_in_blocks(make, monkeypatch):
    for name, value in (("BUCKET_BLOCK", 5), ("GROUP_BLOCK", 7)):
        monkeypatch.setattr(minhash, name, value)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    check(make(rows(*noisy_group(rng, base, 60, 0.03), *noisy_group(rng, base, 20, 0.1))), 2)


def test_near_duplicates_of_odd_tables(edge, nothing, make):
    check(edge, 2)
    assert near_duplicates(nothing).count() == 0
    # One doc_id with two texts links both groups.
    a, b = "alpha beta gamma delta", "one two three four"
    check(make([*rows(a, b), *rows(a, first=5), *rows(b, first=5)]), 2)


def test_near_copies_of_both_texts_of_a_document(spark, make):
    rng = random.Random(5)
    a, b = ([f"{c}{i}" for i in range(120)] for c in "ab")
    near = lambda t: " ".join([*t[:-2], "x", "y"])
    data = [*rows(" ".join(a), first=5), *rows(" ".join(b), first=5), *rows(near(b), first=7), *rows(near(a), first=9), *rows("other words here", first=11)]
    for parts in (1, 3, 8):
        rng.shuffle(data)
        df = make(data).repartition(parts)
        got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, k=2).collect()}
        assert got == {5: 5, 7: 5, 9: 5, 11: 11}
    # One doc_id with many texts, a near copy of the last.
    many = [[f"t{j}w{i}" for i in range(60)] for j in range(30)]
    data = [x for t in many for x in rows(" ".join(t), first=3)] + rows(near(many[-1]), near(many[0]), first=20)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(make(data), k=2).collect()}
    assert got == {3: 3, 20: 3, 21: 3}


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[1000:]
    sig = minhash.signatures([a, b, a[:1]])
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.12 and (sig[0] != sig[2]).mean() > 0.9


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5400)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n for n in want if n not in got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(rng, n, centres, spread, width=32):
    c = rng.normal(size=(centres, width))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, width))


def brute_vectors(ids, v, least=0.9):
    width = max(len(x) for x in v if x is not None)
    ok = [i for i, x in enumerate(v) if x is not None and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    x = np.array([list(v[i]) + [0.0] * (width - len(v[i])) for i in ok])
    x /= np.abs(x).max(1, keepdims=True)
    s = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1) >= least
    np.fill_diagonal(s, False)
    n = dict.fromkeys(range(len(v)), 0) | {i: int(k) for i, k in zip(ok, s.sum(1))}
    comp = components(set(ids), [(ids[ok[a]], ids[ok[b]]) for a, b in np.argwhere(s)])
    return sorted((ids[i], n[i], comp[ids[i]], comp[ids[i]] == ids[i]) for i in range(len(v)))


@pytest.mark.parametrize("block", [1024, 16])
def test_near_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rng = np.random.default_rng(4)
    v = [[float(y) for y in x] for x in np.concatenate((vectors(rng, 150, 1, 0.15), vectors(rng, 150, 30, 0.2), rng.normal(size=(200, 32))))]
    v += [v[0], v[0], v[200], None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [1e300] * 32, [2e300] * 32, v[3][:20]]
    ids = list(range(10, 10 + len(v)))
    df = spark.createDataFrame([(i, x, "a") for i, x in zip(ids, v)], "vec_id long, embedding array<double>, rep string").repartition(3)
    assert sorted(map(tuple, near_vectors(df).collect())) == brute_vectors(ids, v)


def test_recall_on_hard_pairs(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(700, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(700, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    pairs = np.concatenate((a, 0.905 * a + np.sqrt(1 - 0.905**2) * b))
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(pairs)], "vec_id long, embedding array<double>")
    assert near_vectors(df).where("n_links > 0").count() >= 0.98 * 1400


def test_near_vectors_of_odd_tables(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, near_vectors(df).collect()), key=repr) == sorted([(None, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)], key=repr)
    assert near_vectors(df.limit(0)).count() == 0
    assert near_vectors(df.where("vec_id is null")).count() == 1


def test_links_of_a_list_against_all_its_pairs():
    """Sparse and dense lists, whole and in two blocks: enough shared pivots, ``pivot`` the smallest, and near."""
    rng = np.random.default_rng(8)
    for n, spread, blocks in [(2, 0.0, 1), (40, 0.02, 1), (300, 0.3, 1), (300, 0.3, 2), (200, 0.05, 2), (120, 3.0, 1)]:
        x = vectors(rng, n, 40 if spread > 0.05 else 3, spread)
        x /= np.linalg.norm(x, axis=1)[:, None]
        orders = np.array([np.append(rng.choice(np.setdiff1d(np.arange(30), [9]), 5, replace=False), 9) for _ in range(n)]).astype(np.int16)
        blk = rng.integers(0, blocks, n) if n > 2 else np.zeros(n, int)
        want = np.zeros((n, n), bool)
        for i in range(n):
            for j in range(n):
                both = set(orders[i].tolist()) & set(orders[j].tolist())
                want[i, j] = i != j and (blocks == 1 or blk[i] != blk[j]) and len(both) >= 2 and min(both) == 9 and x[i] @ x[j] >= 0.9
        got = pivots.linked(x, orders, blk, 9, 0.9, 2)
        assert (np.zeros((n, n), bool) if got is None else got).tolist() == want.tolist(), (n, spread, blocks)


def test_vectors_travel_in_their_own_precision(spark, monkeypatch):
    """What the lists are dealt from holds single precision as four bytes a component, with the same links."""
    held = {}
    write = pivots.materialise
    monkeypatch.setattr(pivots, "materialise", lambda df, label: held.setdefault(label, write(df, label)))
    v = vectors(np.random.default_rng(5), 200, 20, 0.15).astype(np.float32)
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert held["described"].schema["v"].dataType.simpleString() == "array<float>"
    assert sorted(map(tuple, got)) == brute_vectors(list(range(200)), [x for _, x in rows])
    assert sum(r["n_links"] for r in got) > 200
