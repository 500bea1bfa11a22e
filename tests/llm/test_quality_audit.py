from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from .conftest import rows
from oracle import compare, duck

from wavegauge.llm import audit
from wavegauge.llm.repetition import Suffixes, maximal_repeats, quality_rules


def plain_repeats(words, least):
    """Maximal repeated substrings by brute force: {words: occurrences}."""
    n = len(words)
    counts = Counter(tuple(words[i:j]) for i in range(n) for j in range(i + least, n + 1))
    out = {}
    for g, c in counts.items():
        if c < 2:
            continue
        at = [i for i in range(n - len(g) + 1) if tuple(words[i : i + len(g)]) == g]
        before = {words[i - 1] if i else ("start",) for i in at}
        after = {words[i + len(g)] if i + len(g) < n else ("end",) for i in at}
        if len(before) > 1 and len(after) > 1:
            out[g] = c
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=1, max_size=4), st.integers(1, 4))
def test_suffixes_against_brute_force(texts, least):
    codes = np.array([c for t in texts for c in t], np.int64)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    s = Suffixes.of(codes, first)
    got = {}
    for at, size, times in zip(*s.maximal(least)):
        got[(int(s.text[at]), tuple(codes[at : at + size].tolist()))] = int(times)
    want, covered, longest = {}, [], []
    for i, t in enumerate(texts):
        found = plain_repeats(t, least)
        want |= {(i, g): c for g, c in found.items()}
        hit = set()
        for g in found:
            hit |= {p + o for p in range(len(t)) for o in range(len(g)) if tuple(t[p : p + len(g)]) == g}
        covered += [p in hit for p in range(len(t))]
        every = {tuple(t[a:b]) for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        times = {g: sum(tuple(t[p : p + len(g)]) == g for p in range(len(t))) for g in every}
        longest += [max([b - p for b in range(p + 1, len(t) + 1) if times[tuple(t[p:b])] > 1], default=0) for p in range(len(t))]
    assert got == want
    assert s.covered(least).tolist() == covered
    assert s.longest().tolist() == longest


def test_quality_edge_cases(edge, nothing):
    out = {}
    for r in quality_rules(edge).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert len(out[5]) == 3 and len({tuple(r) for r in out[5]}) == 1
    assert out[0][0]["n_words"] == 0 and out[0][0]["base_failed"] and not out[0][0]["kept"]
    long = out[4][0]
    assert (long["n_words"], long["n_repeat_words"], long["longest_repeat"]) == (60_001, 60_000, 59_999) and long["base_failed"]
    assert out[7][0]["word_chars"] == 7 and len(out[None]) == 3
    assert quality_rules(nothing).count() == 0 and maximal_repeats(nothing).count() == 0


def test_long_repeat_is_dropped_and_a_boilerplate_line_is_kept(make):
    prose = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    licence = prose("l", 13)
    passage = prose("p", 51)
    data = rows(f"{prose('a', 200)}\n{licence}\n{prose('b', 40)}\n{licence}", f"{prose('a', 300)} {passage} {prose('b', 200)} {passage}", " ".join(f"{prose(f'm{i}_', 16)}" for i in [*range(6), *range(3)]))
    out = {r["doc_id"]: r for r in quality_rules(make(data)).collect()}
    assert [out[i]["kept"] for i in range(3)] == [True, False, False]
    assert out[0]["n_dup_lines"] == 1 and out[1]["longest_repeat"] == 51 and not out[1]["base_failed"]
    found = maximal_repeats(make(data)).where("doc_id = 1").collect()
    assert [(r["first_word"], r["n_words"], r["occurrences"], r["repeat"]) for r in found] == [(found[0]["first_word"], 51, 2, passage)]
    assert found[0]["first_word"] in (300, 551)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_quality_rules"])
def test_query_matches_sql(spark, sf, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, sf).toPandas()
    assert compare(got, duck(sf).execute(entry.oracle_sql()[name]).fetchdf()) == ""


def plain_audit(docs, labels):
    """Every order walked filter by filter over plain rows."""
    import re
    from itertools import permutations

    first = {}
    for r in docs:
        if r["doc_id"] is not None:
            first[r["text"] or ""] = min(r["doc_id"], first.get(r["text"] or "", r["doc_id"]))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for r in docs:
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        f += "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * (r["doc_id"] is not None and r["doc_id"] > first[text])
        fails.append((r["lang"] or "", f, r["doc_id"] in good, r["doc_id"] in toxic))
    out, share = {}, Counter()
    for part in {f[0] for f in fails}:
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                here = [f for f in left if x in f[1]]
                out[part, "".join(order), step] = [len(left) - len(here), len(here), sum(x in f[1] for f in gone), sum(f[0] == part and f[1] == x for f in fails), sum(f[2] for f in here), sum(f[3] for f in here)]
                share[part, x] += len(here)
                gone += here
                left = [f for f in left if x not in f[1]]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


NUMBERS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_edge_cases(spark, edge, nothing, monkeypatch):
    labels = [(1, 1, 0), (2, 0, 1), (5, 1, 1), (5, None, None), (6, 1, 0), (None, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = plain_audit([r.asDict() for r in edge.collect()], labels)
    for size in (1 << 22, 40):  # shards of many texts and of one
        monkeypatch.setattr(audit, "SHARD_BYTES", size)
        got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in NUMBERS) for r in audit.filter_audit(edge, table).collect()}
        assert got == want
    assert audit.filter_audit(nothing, table).count() == 0
    assert audit.filter_audit(edge, table.limit(0)).count() == len(want)


def test_matrix_holds_every_word_count(spark, edge, monkeypatch):
    monkeypatch.setattr(audit, "DICTIONARY_SLICE", 7)
    totals = Counter()
    for r in edge.collect():
        totals.update((r["text"] or "").split())
    cells = Counter()
    for m in audit.document_term_matrix(edge).collect():
        ends, columns, counts = (np.frombuffer(m[c], t).tolist() for c, t in (("row_ends", np.int64), ("columns", np.int64), ("counts", np.int32)))
        assert len(columns) == len(counts) == ends[-1] and len(m["doc_ids"]) == len(ends)
        for lo, hi in zip([0, *ends], ends):
            assert columns[lo:hi] == sorted(set(columns[lo:hi]))
        for c, n in zip(columns, counts):
            cells[c] += n
    assert sorted(cells.values()) == sorted(totals.values())


def test_audit_reads_the_matrix_in_the_process_that_makes_it(spark):
    """Two Python steps in one stage would hold two processes a task."""
    from wavegauge.llm import audit

    d = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x")], "doc_id long, text string, lang string")
    plan = audit.failed_filters(d)._jdf.queryExecution().executedPlan().toString()
    last = plan.split("Exchange")[0]
    assert last.count("MapInArrow") == 1
