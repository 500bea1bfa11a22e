import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare, duck

from wavegauge.llm import phrases as P


def plain(docs, threshold, top):
    """All phrases counted at once, scored and dropped one by one."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    best = {}
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= threshold}
    for (lang, g), a in found.items():
        cuts = [(2_000_000 * a // (f[lang, g[:j]] + f[lang, g[j:]]), j) for j in range(1, len(g))]
        score, j = min(cuts)
        inside = lambda q: any(q[i : i + len(g)] == g for i in range(len(q) - len(g) + 1))
        if not any(at == lang and len(q) > len(g) and 100 * b >= 80 * a and inside(q) for (at, q), b in found.items()):
            best[lang, " ".join(g)] = (a, f[lang, g[:j]], f[lang, g[j:]], score)
    out = []
    for lang in {x[0] for x in best}:
        order = sorted(((p, v) for (at, p), v in best.items() if at == lang), key=lambda x: (-x[1][3], -x[1][0], x[0].encode()))
        out += [(lang, i, p, *v[:3], n[lang], v[3]) for i, (p, v) in enumerate(order[:top], 1)]
    return sorted(out)


def corpus(seed, n):
    r = random.Random(seed)
    words = ["The", "of", "é", "New", "York", "city", "x\x00y", "日本", "a-b"]
    out = []
    for i in range(n):
        text = ""
        for _ in range(r.randrange(0, 40)):
            text += r.choice(["New York City", "the quick brown fox", r.choice(words), r.choice(words)]) + r.choice([" ", "  ", "\t", ". ", "\n", ",", "\x0b", " "])
        out.append((r.choice(["en", "fr", None, ""]), r.choice([text, text, None, ""]) if i % 9 == 0 else text))
    return out + [("en", "New York " * 400), ("de", "one two three four five"), ("en", out[0][1])]


@pytest.mark.parametrize("shards", [1, 2])
def test_against_plain_counting(spark, shards):
    docs = corpus(shards, 60)
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "'x' as phrase", "1 as n", "2 as step").repartition(4)
    got = P.collocations(df, threshold=4, shards=shards, top=25, block_bytes=600)
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, 4, 25)


def test_a_full_filter_loses_no_phrase_of_a_block(monkeypatch):
    monkeypatch.setattr(P.Filter, "has", lambda self, h: np.ones(len(h), bool))
    tokens = np.array([0, 1, -1, 1, 0, 1], np.int32)
    found = P.block_phrases("en", pa.array([b"a", b"b"], pa.large_binary()), tokens, True, P.Filter(np.zeros(8, np.uint8)), {1, 2}, 4)
    assert {k: dict(zip(p.to_pylist(), c.tolist())) for k, p, c in found} == {1: {b"a": 2, b"b": 3}, 2: {b"a b": 2, b"b a": 1}, 3: {b"b a b": 1}}


def test_edges(spark, nothing, edge):
    assert P.collocations(nothing).count() == 0
    out = P.collocations(edge, threshold=2)
    assert {r["lang"] for r in out.collect()} <= {"en", "und"}
    with pytest.raises(ValueError):
        P.frequent_phrases(edge, shards=0)


def test_query_matches_sql(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = entry.queries()["op13_collocations"](spark, sf).toPandas()
    assert compare(got, duck(sf).execute(entry.oracle_sql()["op13_collocations"]).fetchdf()) == ""
