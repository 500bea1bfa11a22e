import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavegauge.llm import lm, packing, pieces
from wavegauge.llm.lm import cross_entropy_difference
from wavegauge.llm.pieces import decode_pieces, encode_pieces
from wavegauge.llm.text import slices
from wavegauge.llm.toxicity import score_toxicity, train_toxicity

from .conftest import rows

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a <|endoftext|>b<|startoftext|>", "é  ́x", "don't\x1cstop we're\x85x", "İΣΑΣ", " x", "가각 ᄀ ᅡ", "", "H̱ ẖ", "don't. it's), A.b.c!! <|ENDOFTEXT|>.", "x" * 900 + " ...",
    "á.b́. 5.́", "..", "ａｂ. ² ½, İx.", "\x00\x0b\x0c\r\n\t end", "日本語テキスト。🦄 ﬁ",
]
TEXT = st.text(alphabet=st.sampled_from(list("abAB 's.,!?*\n\té日́ßİ1½<|>")), max_size=60)


def test_tokens_against_the_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(TEXT, max_size=6))
    def same(texts):
        for t in slices(pa.array([*texts, "end"])):
            ids, counts = packing.encode_texts(t, WORD_BPE)
            want = [e.ids for e in tok.encode_batch([*texts, "end"], add_special_tokens=False)]
            assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x]

    same()
    for x in ODD:
        assert packing.encode_texts(next(slices(pa.array([x]))), WORD_BPE)[0].tolist() == tok.encode(x, add_special_tokens=False).ids, x


def packed(df, size):
    got = packing.pack_documents(df, WORD_BPE, size=size, ids=True).collect()
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0) and r["length"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= size for n in at.values())
    return got, at


def test_packing_of_odd_tables(edge, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD_BPE)
    got, _ = packed(edge, 64)
    want = Counter()
    for r in edge.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.update((r["doc_id"], p, 64 * p, np.asarray(ids[64 * p : 64 * (p + 1)], "<u4").tobytes()) for p in range(-(-len(ids) // 64)))
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in got) == want
    assert packing.pack_documents(nothing, WORD_BPE).count() == 0


def test_packing_is_tight(spark, sf):
    got, at = packed(spark.read.parquet(f"{sf}/documents.parquet"), 2048)
    assert len(at) <= math.ceil(sum(r["length"] for r in got) / 2048) + 3


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 128), st.integers(1, 400), max_size=40))
def test_plan_places_every_piece_once(histogram):
    runs = packing.plan(histogram, 128)
    fill = {}
    ranks = Counter()
    for length, first, base, n, offset in sorted(runs.tolist(), key=lambda r: (r[0], r[1])):
        assert first == ranks[length]
        ranks[length] += n
        for s in range(base, base + n):
            fill.setdefault(s, []).append((offset, length))
    assert ranks == Counter(histogram)
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 128
    bins: list[int] = []  # first fit decreasing, piece by piece
    for length in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        at = next((i for i, free in enumerate(bins) if free >= length), None)
        if at is None:
            bins.append(128 - length)
        else:
            bins[at] -= length
    assert len(fill) <= len(bins) + 1


def test_patterns_carry_most_pieces():
    rng = np.random.default_rng(4)
    for n, share in ((1_000, 0.8), (20_000, 0.9)):
        lengths = np.clip(rng.lognormal(6.4, 0.9, n).astype(int) + 1, 1, 2048)
        histogram = Counter(lengths.tolist())
        fitted = packing.fit_patterns(histogram, 2048)
        used = Counter()
        for parts, k in fitted:
            assert sum(parts) <= 2048 and k > 0
            used.update({x: k * c for x, c in Counter(parts).items()})
        assert all(used[x] <= histogram[x] for x in used)
        assert sum(used.values()) >= share * (lengths < 2048).sum()
        runs = packing.plan(histogram, 2048)
        assert (runs[:, 2] + runs[:, 3]).max() <= math.ceil(lengths.sum() / 2048 * 1.002)


def test_fit_of_repeats_meets_the_counts():
    lengths = np.arange(1, 64)
    use = packing.patterns(lengths, 64)
    assert all(sum(lengths[i] for i in p if i >= 0) <= 64 for p in use.tolist())
    truth = np.zeros(len(use))
    truth[::7] = 5
    counts = np.zeros(len(lengths))
    for p, x in zip(use.tolist(), truth.tolist()):
        for i in p:
            counts[i] += x * (i >= 0)
    x = packing.fit_repeats(use, counts, 400)
    made = np.zeros(len(lengths))
    for p, n in zip(use.tolist(), x.tolist()):
        for i in p:
            made[i] += n * (i >= 0)
    assert (x >= 0).all() and np.abs(made - counts).max() < 0.05 * counts.max()


@pytest.fixture(scope="module")
def unigram():
    """The library's own unigram encoder over the same pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(PIECE, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    least = min(p.score for p in m.pieces if p.score > pieces.FORBIDDEN)
    for p in m.pieces:
        p.score = max(p.score, least - pieces.FLOOR)
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def test_pieces_against_the_library_and_round_trip(spark, sf, unigram):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = decode_pieces(encode_pieces(docs, PIECE).selectExpr("*", "ids as kept"), PIECE).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["decoded"] == r["text"] and r["kept"] == unigram.encode(r["text"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abthe  ing\n\té日🦄\x00.")), max_size=40), max_size=5))
def test_pieces_round_trip(texts):
    for t in slices(pa.array([*texts, "x"])):
        ids, counts = pieces.encode_texts(t, PIECE)
        assert pieces.decode_ids(ids.astype(np.int64), counts, PIECE) == [*texts, "x"]


def test_pieces_of_odd_tables(edge, nothing, unigram):
    for r in encode_pieces(edge, PIECE).collect():
        assert r["ids"] == (unigram.encode(r["text"]) if r["text"] else [])
    assert decode_pieces(encode_pieces(nothing, PIECE), PIECE).count() == 0


def plain_losses(text, counted, order, prior):
    raw, out = text.encode(), 0.0
    grams = [Counter() for _ in range(order + 1)]
    for t in counted:
        b = t.encode()
        for n in range(1, order + 1):
            grams[n].update(b[i : i + n] for i in range(len(b) - n + 1))
    for i in range(len(raw)):
        p = (grams[1][raw[i : i + 1]] + prior / 256) / (sum(grams[1].values()) + prior)
        for n in range(2, min(order, i + 1) + 1):
            context = grams[n - 1][raw[i - n + 1 : i]]
            p = (min(grams[n][raw[i - n + 1 : i + 1]], context) + prior * p) / (context + prior)
        out -= math.log(p)
    return out / max(len(raw), 1)


def test_cross_entropy_difference_against_a_plain_model(spark, make):
    texts = ["the cat sat on the mat", "a dog and a cat é", "", "日本 the end", "mat mat mat", None, "the cat sat on the mat"]
    docs = make(rows(*texts))
    targets = spark.createDataFrame([(0,), (3,), (0,), (None,), (99,)], "doc_id long")
    got = {r["doc_id"]: r for r in cross_entropy_difference(docs, targets).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = [plain_losses(t, c, lm.ORDER, lm.PRIOR) for c in ([texts[0], texts[3]], [x for x in texts if x])]
        assert got[i]["n_tokens"] == len(t.encode())
        assert (got[i]["target_loss"], got[i]["background_loss"]) == pytest.approx(want, rel=1e-4)
        assert got[i]["score"] == pytest.approx(want[0] - want[1], abs=1e-4)


def test_cross_entropy_difference_counts_exactly_on_many_grams(spark, make):
    r = random.Random(5)
    texts = ["".join(chr(r.randrange(33, 127)) for _ in range(30_000)) for _ in range(20)]
    docs = make(rows(*texts))
    targets = spark.createDataFrame([(0,), (7,)], "doc_id long")
    got = {x["doc_id"]: x for x in cross_entropy_difference(docs, targets).collect()}
    # More distinct grams than any fixed table of 2^20 slots keeps apart.
    for i in (0, 1, 7):
        want = [plain_losses(texts[i], c, lm.ORDER, lm.PRIOR) for c in ([texts[0], texts[7]], texts)]
        assert (got[i]["target_loss"], got[i]["background_loss"]) == pytest.approx(want, rel=1e-9)
    few = {x["doc_id"]: x["score"] for x in cross_entropy_difference(docs, targets, block_bytes=50_000).collect()}
    assert all(few[i] == pytest.approx(x["score"], abs=1e-9) for i, x in got.items())


def test_scores_of_odd_tables(edge, nothing, spark):
    got = cross_entropy_difference(edge, spark.createDataFrame([(4,)], "doc_id long")).collect()
    assert len(got) == edge.count() and all(math.isfinite(r["score"]) for r in got)
    assert next(r for r in got if r["doc_id"] == 4)["score"] < 0
    assert cross_entropy_difference(nothing, spark.createDataFrame([], "doc_id long")).count() == 0


def toxic_corpus(n, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choices(["an", "er", "the", "ing", "ou", "st", "re"], k=r.randrange(1, 5)))
    texts, y = [], []
    for i in range(n):
        w = [word() for _ in range(r.randrange(5, 80))]
        y.append(int(r.random() < 0.2))
        if y[-1]:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["grumpf", "vlokt"]) + word())
        texts.append(" ".join(w))
    return texts, y


def test_toxicity_on_rows_kept_aside(spark, make):
    texts, y = toxic_corpus(900)
    docs = make(rows(*texts))
    labels = spark.createDataFrame([(i, v, v) for i, v in enumerate(y)] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    model = train_toxicity(docs, labels)
    out = score_toxicity(docs, model)
    got = {r["doc_id"]: r for r in out.collect()}
    aside = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i]["score"] >= 0.5) == y[i] for i in aside]) > 0.95
    # The score depends on the text alone.
    other = score_toxicity(docs.selectExpr("doc_id + 1000000 as doc_id", "text", "'xx' as lang"), model).collect()
    assert all(abs(r["score"] - got[r["doc_id"] - 1000000]["score"]) < 2e-6 for r in other)


def test_toxicity_thresholds_use_labelled_rows_beyond_the_fit_sample(spark, make):
    texts, y = toxic_corpus(900, seed=8)
    langs = ["rare" if i % 9 == 0 else "en" for i in range(900)]
    docs = make([(*r[:2], c, *r[3:]) for r, c in zip(rows(*texts), langs)])
    labels = spark.createDataFrame([(i, v, v) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    # A tenth of the rows fit the model; the rare language has enough labelled rows only in the whole table.
    assert set(train_toxicity(docs, labels, n_toxic=40, n_clean=50).thresholds) == {"en", "rare"}


def test_toxicity_of_odd_tables(edge, nothing, spark):
    labels = spark.createDataFrame([(3, 0, 1), (4, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    for part in (labels, labels.limit(0), labels.where("toxic = 0")):
        model = train_toxicity(edge, part)
        got = score_toxicity(edge, model, keep=("text",)).collect()
        assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
        assert score_toxicity(nothing, model).count() == 0
    assert score_toxicity(edge, train_toxicity(nothing, labels)).count() == edge.count()


def test_toxicity_model_travels_without_untouched_rows():
    import pickle

    from wavegauge.llm import toxicity as T

    texts = [f"word{i % 9} thing{i % 5} bad" if i % 2 else f"word{i % 9} thing{i % 7} good" for i in range(60)]
    m = T.fit(texts, np.arange(60) % 2, np.full(60, 1.0))
    data = pickle.dumps(m)
    again = pickle.loads(data)
    assert len(data) < 100_000 and (again.embed == m.embed).all() and again.embed.dtype == m.embed.dtype
    assert len(pickle.dumps(again)) < 100_000
