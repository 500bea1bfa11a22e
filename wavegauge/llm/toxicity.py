"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first bytes, so that forms
not seen in training share what their stems have learned. Filters of several widths run over the
words, each keeps its largest response in the text, and a logistic layer reads these maxima. The
fit uses a bounded sample of labelled rows; score and language thresholds are calibrated on a histogram
of all labelled rows that the fit has not seen. Scores depend on the text alone.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, Texts, byte_hashes, mix64, runs, slices

# Bounds of the training sample: rows of each class and UTF-8 bytes of each class.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 3000, 4000, 6 << 20
WORD_BITS, STEM_BITS, STEMS = 17, 16, (4, 5, 6)
DIM, WIDTHS, FILTERS = 12, (1, 2, 3), 8
EPOCHS, BATCH, RATE = 4, 64, 0.05
# Labelled rows of each class that a language needs for a threshold of its own.
CALIBRATION_ROWS = 8
# Digits of the logits in the histogram.
LOGIT_DIGITS = 2

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(key: Column) -> Column:
    """Rows never used to fit: crc32 of the key as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of every word (the word itself and its stems) and the first word of each text + end."""
    start, length = runs(t, _WORD)
    low = LOWER[t.data]
    out = np.empty((len(start), 1 + len(STEMS)), np.int32)
    out[:, 0] = byte_hashes(low, start, length) >> np.uint64(64 - WORD_BITS)
    windows = np.ndarray((max(len(low) - 7, 0),), "<u8", low, strides=(1,))
    base = 1 << WORD_BITS
    head = windows[start] if len(start) else np.zeros(0, np.uint64)
    for i, k in enumerate(STEMS):
        keep = np.uint64(64) - np.minimum(length, k).astype(np.uint64) * np.uint64(8)
        out[:, i + 1] = (mix64(((head << keep) >> keep) ^ np.uint64(k << 60)) >> np.uint64(64 - STEM_BITS)).astype(np.int32) + base
        base += 1 << STEM_BITS
    return out, np.searchsorted(start, t.start)


def _random_rows(rng: np.random.Generator) -> np.ndarray:
    """The embedding before it has seen any text."""
    return rng.normal(0, 0.05, ((1 << WORD_BITS) + len(STEMS) * (1 << STEM_BITS), DIM)).astype(np.float32)


@dataclass
class ToxicityModel:
    embed: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    out: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    seed: int | None = None  # of the generator that made the embedding

    def __getstate__(self) -> dict:
        """Without the embedding rows that no text has touched: the seed gives them again."""
        if self.seed is None:
            return self.__dict__
        fresh = _random_rows(np.random.default_rng(self.seed))
        fresh[:, 0] = 0
        own = np.flatnonzero((self.embed != fresh).any(1))
        return self.__dict__ | {"embed": (own.astype(np.int32), self.embed[own])}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        if self.seed is not None:
            own, rows = self.embed
            self.embed = _random_rows(np.random.default_rng(self.seed))
            self.embed[:, 0] = 0
            self.embed[own] = rows

    def responses(self, f: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors, and each filter's response at every word; words beyond the text count as zero."""
        x = self.embed[f[:, 0]]
        for i in range(1, f.shape[1]):
            x = x + self.embed[f[:, i]]
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        z = []
        for w in self.filters:
            y = x @ w[0]
            for j in range(1, len(w)):
                same = (text[j:] == text[:-j]).astype(np.float32)[:, None]
                y[: len(x) - j] += (x[j:] @ w[j]) * same
            z.append(y)
        return x, np.concatenate(z, 1)

    def pooled(self, z: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first) - 1, z.shape[1]), np.float32)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            out[some] = np.maximum(np.maximum.reduceat(z, first[some], axis=0), 0)
        return out

    def logits(self, f: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(self.responses(f, first)[1], first).astype(np.float64) @ self.out + self.bias

    def score(self, logits: np.ndarray) -> np.ndarray:
        """Scores of six digits: sums of floats may differ beyond that with the texts computed together."""
        return np.round(1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -60, 60))), 6)


def _start(f: np.ndarray, first: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> ToxicityModel:
    """Small random weights; one dimension begins at the log odds of a feature among the texts, read by one filter."""
    rows = (1 << WORD_BITS) + len(STEMS) * (1 << STEM_BITS)
    embed = _random_rows(rng)
    toxic, clean = np.zeros(rows), np.zeros(rows)
    for a, b, c in zip(first[:-1], first[1:], y):
        (toxic if c else clean)[np.unique(f[a:b])] += 1
    odds = np.log((toxic + 1) / (y.sum() + 2)) - np.log((clean + 1) / ((1 - y).sum() + 2))
    embed[:, 0] = np.where(toxic + clean > 0, 0.3 * odds, 0)
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    filters[0][0, :, 0] = np.eye(DIM)[0]
    out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS)
    out[0] = 1.0
    return ToxicityModel(embed, filters, out, -1.0)


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> ToxicityModel:
    """Adaptive gradient steps on the weighted logistic loss; the gradient of a maximum flows to its word."""
    rng = np.random.default_rng(seed)
    parts = [features(t) for t in slices(pa.array(texts, pa.string()), 1 << 20)]
    f = np.concatenate([p[0] for p in parts])
    first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))))
    m = _start(f, first, y, rng)
    m.seed = seed
    g_embed = np.full(len(m.embed), 1e-2, np.float32)
    g_filters, g_out, g_bias = [np.full_like(w, 1e-2) for w in m.filters], np.full_like(m.out, 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            docs = order[lo : lo + BATCH]
            size = np.diff(first)[docs]
            begin = np.concatenate(([0], np.cumsum(size)))
            at = np.repeat(first[docs] - begin[:-1], size) + np.arange(begin[-1])
            fb = f[at]
            x, z = m.responses(fb, begin)
            pool = m.pooled(z, begin)
            p = 1 / (1 + np.exp(-np.clip(pool @ m.out + m.bias, -60, 60)))
            d = (p - y[docs]) * weight[docs] / len(docs)
            step = lambda g, acc: RATE * g / np.sqrt(acc)
            d_pool = d[:, None] * m.out * (pool > 0)
            g = pool.T @ d
            g_out += g * g
            g_b = d.sum()
            g_bias += g_b * g_b
            best = np.stack([z[a:b].argmax(0) + a if b > a else np.zeros(z.shape[1], int) for a, b in zip(begin[:-1], begin[1:])])
            d_x = np.zeros_like(x)
            for k, w in enumerate(m.filters):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                grad = np.zeros_like(w)
                for j in range(len(w)):
                    word = best[:, cols] + j
                    inside = (word < begin[1:, None]) & (d_pool[:, cols] != 0)
                    r, c = np.nonzero(inside)
                    value = d_pool[:, cols][r, c].astype(np.float32)[:, None]
                    np.add.at(grad[j].T, c, value * x[word[r, c]])
                    np.add.at(d_x, word[r, c], value * w[j].T[c])
                g_filters[k] += grad * grad
                w -= step(grad, g_filters[k]).astype(np.float32)
            m.out -= step(g, g_out)
            m.bias -= step(g_b, g_bias)
            hit = np.flatnonzero(d_x.any(1))
            rows = fb[hit].ravel()
            grad = np.repeat(d_x[hit], fb.shape[1], 0)
            np.add.at(g_embed, rows, (grad * grad).mean(1))
            np.add.at(m.embed, rows, -RATE * grad / np.sqrt(g_embed[rows])[:, None])
    return m


def calibrate(m: ToxicityModel, z: np.ndarray, y: np.ndarray, count: np.ndarray, weight: np.ndarray, lang: list) -> None:
    """Scale and shift of the score (logistic fit), then each language's threshold, from a histogram
    of logits by language and label: ``count`` rows in each cell, of ``weight`` each."""
    weight = weight * count
    n_pos, n = (count * y).sum(), count.sum()
    if 0 < n_pos < n:
        a, b = 1.0, 0.0
        target = np.where(y == 1, (n_pos + 1) / (n_pos + 2), 1 / (n - n_pos + 2))
        w = weight / weight.sum()
        for _ in range(50):  # Newton steps, held by a small ridge
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            r, h = w * (p - target), w * p * (1 - p)
            g = np.array([(r * z).sum() + 1e-4 * (a - 1), r.sum() + 1e-4 * b])
            hess = np.array([[(h * z * z).sum() + 1e-4, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-4]])
            da, db = np.linalg.solve(hess, g)
            a, b = max(a - np.clip(da, -1, 1), 0.05), b - np.clip(db, -2, 2)
        m.scale, m.shift = float(a), float(b)
    s = m.score(z)
    lang = np.array([x if x is not None else "" for x in lang], object)
    for code in sorted(set(lang)):
        mine = lang == code
        pos, neg = mine & (y == 1), mine & (y == 0)
        if min(count[pos].sum(), count[neg].sum()) < CALIBRATION_ROWS:
            continue
        cuts = np.unique(s[mine])
        cuts = np.append((cuts[1:] + cuts[:-1]) / 2, 0.5)
        by = np.argsort(s[mine])
        below = np.searchsorted(s[mine][by], cuts)  # cells under each cut
        sums = [np.concatenate(([0.0], np.cumsum(np.where(side[mine], weight[mine], 0)[by]))) for side in (pos, neg)]
        missed = sums[0][below] + sums[1][-1] - sums[1][below]
        ties = cuts[missed <= missed.min() + 1e-9 * weight[mine].sum()]
        m.thresholds[str(code)] = float(ties[np.abs(ties - 0.5).argmin()])


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fit on three quarters of the sample: one row with the model and the keys it has seen; none
    where the sample has a single class."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    sample = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    keys, y = sample["doc_id"].to_pylist(), np.asarray(sample["y"], np.int64)
    if not 0 < y.sum() < len(y):
        return
    aside = mix64(np.array([zlib.crc32(str(k).encode()) for k in keys], np.uint64)) % np.uint64(4) == 0
    use = ~aside if 0 < y[~aside].sum() < (~aside).sum() else np.ones(len(y), bool)
    balanced = np.where(y == 1, 0.5 / max(y[use].mean(), 1e-9), 0.5 / max(1 - y[use].mean(), 1e-9))
    m = fit(sample["text"].filter(pa.array(use)).to_pylist(), y[use], balanced[use])
    seen = sorted({k for k, u in zip(keys, use) if u})
    kind = batches[0].schema.field("doc_id").type
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m)], pa.binary()), pa.array([seen], pa.list_(kind))], ["model", "seen"])


def train_toxicity(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang", n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN, most_bytes: int = SAMPLE_BYTES
) -> ToxicityModel:
    """Fit on at most ``n_toxic`` and ``n_clean`` labelled rows and ``most_bytes`` of text for each class,
    then calibrate on every labelled row that the fit has not seen.

    Rows are taken in the order of a hash of their key until one is beyond the bound (one row at least); held-out rows, rows without a label or a key
    are never used. A key with several labels counts as toxic if one of them says so.
    """
    y = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    h = F.xxhash64("doc_id")
    picked = [y.where(F.col("y") == c).orderBy(h, "doc_id").limit(n) for c, n in ((1, n_toxic), (0, n_clean))]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most n_toxic + n_clean rows
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(lang) if lang in docs.columns else F.lit(None)).cast("string").alias("lang")).join(ids, "doc_id")
    sizes = rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.sum(F.octet_length("text")).alias("n"), F.max(h).alias("h")).collect()
    fit_ids, held, full = [], {0: 0, 1: 0}, set()
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if held[r["y"]] and held[r["y"]] + r["n"] > most_bytes:
            full.add(r["y"])  # a smaller row further on is not taken instead
        if r["y"] not in full:
            held[r["y"]] += r["n"]
            fit_ids.append(r["doc_id"])
    spark = docs.sparkSession
    kind = rows.schema["doc_id"].dataType.simpleString()
    chosen = F.broadcast(spark.createDataFrame([(x,) for x in fit_ids], f"doc_id {kind}"))
    # The fit runs in one task, on the bounded sample alone; only the weights come to the driver.
    fields = f"model binary, seen array<{kind}>"
    fitted = rows.join(chosen, "doc_id").select("doc_id", "text", "y").repartition(1).mapInArrow(_fit_sample, fields).first()
    if fitted is None:  # nothing to tell apart: every text gets the share of toxic labels
        m = ToxicityModel(np.zeros(((1 << WORD_BITS) + len(STEMS) * (1 << STEM_BITS), 1), np.float32), [np.zeros((1, 1, 1), np.float32)], np.zeros(1), 0.0)
        m.shift = float(np.log((total.get(1, 0) + 1) / (total.get(0, 0) + 1)) - 1e-3)
        return m
    m = pickle.loads(fitted["model"])
    seen = F.broadcast(spark.createDataFrame([(x,) for x in fitted["seen"]], f"doc_id {kind}"))
    # Every text is scored where it lies, so that the join moves no text.
    base = docs.select(F.col(key).alias("doc_id"), (F.col(lang) if lang in docs.columns else F.lit(None)).cast("string").alias("lang"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast(m)
    z = base.mapInArrow(_score(shared, logits=True), f"doc_id {kind}, lang string, score double")
    cells = z.join(y, "doc_id").join(seen.withColumn("seen", F.lit(True)), "doc_id", "left").groupBy(F.coalesce("lang", F.lit("")).alias("lang"), F.round("score", LOGIT_DIGITS).alias("z"), "y", F.col("seen").isNotNull().alias("seen"))
    all_cells = cells.agg(F.count("*").alias("n")).orderBy("lang", "z", "y").collect()  # languages times rounded logits
    shared.destroy()
    rest = [r for r in all_cells if not r["seen"]]
    rest = rest if len({r["y"] for r in rest}) == 2 else all_cells
    y_of, n = np.array([r["y"] for r in rest], np.int64), np.array([r["n"] for r in rest], np.int64)
    # Weights give each class the share it has among all labelled rows.
    share = np.array([total[c] / max(n[y_of == c].sum(), 1) for c in (0, 1)])
    calibrate(m, np.array([r["z"] for r in rest]), y_of, n, share[y_of], [r["lang"] for r in rest])
    return m


def _score(shared, logits: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicityModel = shared.value
        for b in batches:
            s = [z if logits else m.score(z) for z in (m.logits(*features(t)) for t in slices(b.column("text"), 1 << 20))]
            names = [f.name for f in b.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(np.concatenate(s) if s else np.zeros(0))], [*names, "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text: doc_id, the columns in ``keep``, score (0 to 1), threshold, rejected.

    The score depends on the text alone; NULL and empty texts have no words and get the score of the
    bias. ``threshold`` is that of the row's language (0.5 where it has none of its own) and
    ``rejected`` is score >= threshold. Repeated rows get equal scores; an empty table gives no rows;
    other columns are ignored.
    """
    carry = {f"keep_{i}": c for i, c in enumerate(keep)}
    languages = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    base = docs.select(F.col(key).alias("doc_id"), languages.alias("lang"), *[F.col(c).alias(a) for a, c in carry.items()], F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    fields = [f"{c} {base.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", *carry)] + ["score double"]
    out = base.mapInArrow(_score(shared), ", ".join(fields))
    cases = F.lit(0.5)
    for code, cut in model.thresholds.items():
        cases = F.when(F.coalesce(F.col("lang"), F.lit("")) == code, cut).otherwise(cases)
    out = out.withColumn("threshold", cases)
    return out.select("doc_id", *[F.col(a).alias(c) for a, c in carry.items()], "score", "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))
