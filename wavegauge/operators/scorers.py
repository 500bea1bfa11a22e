"""Outlier scorers that train from and score DataFrames.

A scorer is built with its feature columns, ``fit(train)`` returns a model and ``model.score(df)``
adds ``score`` (higher is more anomalous). Only small fitted state leaves Spark: column statistics,
a d x d matrix, trees grown on 256 rows, or network weights.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .scale import fits, grouped_quantiles


def training_pool(windows: DataFrame, max_phase: int = 3, max_end: float | None = None, unlabelled: bool = False) -> DataFrame:
    """Early windows used for fitting: up to a phase, ending by ``max_end`` and without a fault label."""
    w = windows.where(F.col("phase_id") <= max_phase)
    if not unlabelled:
        w = w.where(F.col("label_anomaly") == 0)
    return w.where(F.col("t_end_s") <= max_end) if max_end is not None else w


def require_rows(df: DataFrame, what: str = "training pool") -> DataFrame:
    if df.limit(1).count() == 0:
        raise ValueError(f"{what} is empty")
    return df


def hash_sample(df: DataFrame, key: list[str], n: int | None, seed: int = 42) -> DataFrame:
    """At most ``n`` rows (all if None), uniform without replacement and repeatable: smallest hashes of the key.

    A cut on the hash keeps about twice the wanted rows, so the final ordering sees only those.
    """
    if n is None:
        return df
    total = df.count()
    if total <= n:
        return df
    d = df.withColumn("_h", F.xxhash64(F.lit(seed), *key))
    cut = int(-(2**63) + 2**64 * min(1.0, (2.0 * n + 100) / total))
    near = d.where(F.col("_h") < cut) if cut < 2**63 else d
    if near is not d and near.select("_h").limit(n).count() < n:
        near = d
    return near.orderBy("_h", *key).limit(n).drop("_h")


# The JVM-side expressions below are SQL text: 34 columns cost one parse each instead of many calls.


class Preprocessor:
    """Median imputation, then standardisation by the population deviation; fitted on train only.

    A column without any value becomes the constant 0 and is listed in ``empty``.
    """

    def __init__(self, columns: list[str], scale: bool = True):
        self.columns, self.scale = columns, scale

    def fit(self, train: DataFrame, small: bool | None = None) -> "Preprocessor":
        cols = self.columns
        num = train.selectExpr(*[f"cast(`{c}` as double) as `{c}`" for c in cols])
        med = grouped_quantiles(num, [], {c: {f"{c}__med": 0.5} for c in cols}, small=small).first()
        self.median = [med[f"{c}__med"] for c in cols]
        self.empty = [c for c, m in zip(cols, self.median) if m is None]
        self.mean, self.std = [0.0] * len(cols), [1.0] * len(cols)
        if self.scale:
            filled = [self._filled(k) for k in range(len(cols))]
            row = num.selectExpr(*[f"avg({x}) as m{k}" for k, x in enumerate(filled)], *[f"stddev_pop({x}) as s{k}" for k, x in enumerate(filled)]).first()
            self.mean = [row[f"m{k}"] or 0.0 for k in range(len(cols))]
            self.std = [row[f"s{k}"] or 1.0 for k in range(len(cols))]
        return self

    def _filled(self, k: int) -> str:
        m = self.median[k]
        return f"coalesce(cast(`{self.columns[k]}` as double), {float(m if m is not None else 0.0)!r}D)"

    def vector(self) -> Column:
        parts = [f"({self._filled(k)} - {float(m)!r}D) / {float(s)!r}D" for k, (m, s) in enumerate(zip(self.mean, self.std))]
        return F.expr(f"array({', '.join(parts)})")


def moments(vectors: DataFrame, d: int, col: str = "x") -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, column sums and the d x d Gram matrix; partial sums per task, added up in Spark."""

    def partial(batches):
        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf[col].to_numpy())
                n, s, g = n + len(m), s + m.sum(0), g + m.T @ m
        flat = np.concatenate([[float(n)], s, g.ravel()])
        yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

    rows = vectors.select(col).mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + d + d * d)
    for r in rows:  # 1 + d + d*d entries
        flat[r["i"]] = r["v"]
    return int(flat[0]), flat[1 : 1 + d], flat[1 + d :].reshape(d, d)


class Model:
    """Fitted scorer: a preprocessing step and a function from a matrix to scores."""

    def __init__(self, pre: Preprocessor, fn: Callable[[np.ndarray], np.ndarray]):
        self.pre, self.fn = pre, fn

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        fn = self.fn

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            return pd.Series(fn(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

        return df.withColumn(name, run(self.pre.vector()))


class Scorer:
    name = "base"

    def __init__(self, columns: list[str], key: list[str]):
        self.columns, self.key = columns, key

    def fit(self, train: DataFrame) -> Model:
        raise NotImplementedError


class PcaScorer(Scorer):
    """Mean squared residual after projection on the leading right singular vectors."""

    name = "PCA-AE"

    def __init__(self, columns, key, components: int = 5, preprocess: bool = True):
        super().__init__(columns, key)
        self.components, self.preprocess = components, preprocess

    def fit(self, train: DataFrame, small: bool | None = None) -> Model:
        """Medians, then one pass for sums and products of the filled columns."""
        pre = Preprocessor(self.columns, scale=False).fit(train, small)
        d = len(self.columns)
        n, s, g = moments(train.select(pre.vector().alias("x")), d)
        mean = s / max(n, 1)
        cov = g / max(n, 1) - np.outer(mean, mean)
        var = np.diag(cov)
        std = np.where(var > 1e-12 * np.maximum(1.0, mean**2), np.sqrt(np.maximum(var, 0.0)), 1.0)
        pre.mean, pre.std = mean.tolist(), std.tolist()
        gram = n * cov / np.outer(std, std)
        k = max(1, min(self.components, min(n, d) - 1))
        basis = np.linalg.eigh(gram)[1][:, ::-1][:, :k]
        return Model(pre, lambda m: ((m - m @ basis @ basis.T) ** 2).mean(1))


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 3)
    h = np.log(safe - 1) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> tuple:
    """Random splits down to single points or the depth limit: (feature, cut, left, right, depth)."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list[float]] = []
    stack = [(np.arange(len(x)), 0, None, 0)]
    while stack:
        rows, depth, parent, side = stack.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][2 + side] = me
        spread = np.ptp(x[rows], axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or not usable.size:
            nodes.append([-1, 0.0, me, me, depth + float(average_path(len(rows)))])
            continue
        f = int(rng.choice(usable))
        v = x[rows, f]
        cut = rng.uniform(v.min(), v.max())
        nodes.append([f, cut, me, me, 0.0])
        stack.append((rows[v > cut], depth + 1, me, 1))
        stack.append((rows[v <= cut], depth + 1, me, 0))
    a = np.array(nodes)
    return a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]


class IsolationForestScorer(Scorer):
    """2^(-mean depth / c(n)) over trees grown on small random subsamples.

    The subsample of a tree is the rows of the smallest hashes under the tree's own seed, so it is
    drawn from all rows and does not depend on their layout. Tasks keep only rows below a hash that
    leaves about twice the wanted number in the whole table.
    """

    name = "IsoForest"

    def __init__(self, columns, key, trees: int = 200, subsample: int = 256, seed: int = 42):
        super().__init__(columns, key)
        self.trees, self.subsample, self.seed = trees, subsample, seed

    def fit(self, train: DataFrame) -> Model:
        pre = Preprocessor(self.columns).fit(train)
        spark = train.sparkSession
        rows = train.select(F.xxhash64(F.lit(self.seed), *self.key).alias("h"), pre.vector().alias("x"))
        n = train.count()
        size, seed, trees = min(self.subsample, n), self.seed, self.trees
        cut = np.uint64(2**64 - 1) if n <= 2 * size + 100 else np.uint64(int(2**64 * (2 * size + 100) / n))
        salts = np.random.default_rng(seed).integers(1, 2**63, trees).astype(np.uint64)

        def draw(batches):
            for pdf in batches:
                h = pdf["h"].to_numpy().astype(np.int64).view(np.uint64)
                for t in range(trees):
                    z = (h ^ salts[t]) * np.uint64(0x9E3779B97F4A7C15)
                    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    z ^= z >> np.uint64(32)
                    at = np.flatnonzero(z <= cut)
                    if len(at):
                        yield pd.DataFrame({"tree": t, "rank": (z[at] >> np.uint64(1)).astype(np.int64), "x": pdf["x"].iloc[at].to_numpy()})

        def grow(key, pdf):
            t = int(key[0])
            x = np.stack(pdf.nsmallest(size, "rank")["x"].to_numpy())
            f, c, lo, hi, dep = grow_tree(x, np.random.default_rng([seed, t]))
            return pd.DataFrame([(t, f.tolist(), c.tolist(), lo.tolist(), hi.tolist(), dep.tolist())], columns=["tree", "f", "c", "l", "r", "d"])

        schema = "tree int, f array<int>, c array<double>, l array<int>, r array<int>, d array<double>"
        drawn = rows.mapInPandas(draw, "tree int, rank long, x array<double>")
        grown = drawn.groupBy("tree").applyInPandas(grow, schema).collect()  # one small tree each
        forest = [tuple(np.asarray(r[k]) for k in ("f", "c", "l", "r", "d")) for r in sorted(grown, key=lambda r: r["tree"])]
        held = spark.sparkContext.broadcast(forest)
        depth, norm = int(np.ceil(np.log2(max(size, 2)))), float(average_path(size)) or 1.0

        def score(m: np.ndarray) -> np.ndarray:
            total = np.zeros(len(m))
            every = np.arange(len(m))
            for f, c, lo, hi, dep in held.value:
                at = np.zeros(len(m), int)
                for _ in range(depth):
                    # Leaves point at themselves, so extra steps do no harm.
                    at = np.where(m[every, np.maximum(f[at], 0)] <= c[at], lo[at], hi[at])
                total += dep[at]
            return 2.0 ** (-(total / len(held.value)) / norm)

        return Model(pre, score)


# --- local outlier factor ----------------------------------------------------------------------

BLOCK = 16_384
# Distances that are held at a time.
CELLS = 1 << 22


def _nearest(q: np.ndarray, q_id: np.ndarray, t: np.ndarray, t_id: np.ndarray, k: int, skip_self: bool):
    """k nearest training rows per query row, ties by id.

    Distances from a matrix product single out the rows that may be among the nearest, all those within its
    rounding error; only these are computed by differences and ordered.
    """
    out_i, out_d = [], []
    kk = min(k, len(t))
    t_norm = (t * t).sum(1)
    rounding = 8 * (q.shape[1] + 4) * np.finfo(float).eps
    step = max(1, min(512, CELLS // max(len(t), 1)))
    for s in range(0, len(q), step):
        part, own = q[s : s + step], q_id[s : s + step]
        norm = (part * part).sum(1)
        slack = 2 * rounding * (norm + t_norm.max(initial=0.0))
        with np.errstate(invalid="ignore", over="ignore"):
            near = norm[:, None] + t_norm - 2 * (part @ t.T)
        if skip_self:
            near[own[:, None] == t_id[None, :]] = np.inf
        if np.isfinite(slack).all():
            row, col = np.nonzero(near <= (np.partition(near, kk - 1, 1)[:, kk - 1] + slack)[:, None])
        else:  # values that are not finite or overflow: every row is compared
            row, col = (x.ravel() for x in np.indices(near.shape))
        d2 = np.zeros(len(row))
        for j in range(q.shape[1]):
            d2 += (part[row, j] - t[col, j]) ** 2
        if skip_self:
            d2[own[row] == t_id[col]] = np.inf
        order = np.lexsort((t_id[col], d2, row))
        first = np.searchsorted(row, np.arange(len(part)))  # rows ascend
        order = order[(first[:, None] + np.arange(kk)).ravel()]
        out_i.append(t_id[col[order]].reshape(-1, kk))
        out_d.append(np.sqrt(d2[order]).reshape(-1, kk))
    return np.concatenate(out_i), np.concatenate(out_d)


NEIGHBOUR_SCHEMA = "qid long, nid long, dist double"


def nearest_neighbours(queries: DataFrame, train: DataFrame, k: int, skip_self: bool = False, cap: int = 20_000) -> DataFrame:
    """Exact k nearest training rows per query (both with ``id`` and ``x``): qid, nid, dist.

    A training table of at most ``cap`` rows (checked) is shared with every task. A larger one is cut
    into blocks that meet the query chunks pairwise; each meeting keeps k rows per query, and the
    partial results are merged per query.
    """
    spark = train.sparkSession

    def emit(ids, nid, dist) -> pd.DataFrame:
        kk = nid.shape[1]
        out = pd.DataFrame({"qid": np.repeat(ids, kk), "nid": nid.ravel(), "dist": dist.ravel()})
        return out[np.isfinite(out["dist"])]

    if fits(train, cap):
        rows = train.select("id", "x").collect()  # at most cap rows
        held = spark.sparkContext.broadcast((np.array([r["id"] for r in rows]), np.stack([np.asarray(r["x"]) for r in rows])))

        def search(batches):
            t_id, t = held.value
            for pdf in batches:
                if len(pdf):
                    ids = pdf["id"].to_numpy()
                    yield emit(ids, *_nearest(np.stack(pdf["x"].to_numpy()), ids, t, t_id, k, skip_self))

        width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
        return queries.select("id", "x").repartition(width, "id").mapInPandas(search, NEIGHBOUR_SCHEMA)
    blocks = -(-train.count() // BLOCK)
    chunks = max(1, -(-queries.count() // BLOCK))
    b = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    c = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    q = queries.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("_c")).withColumn("_b", b)
    t = train.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_b")).withColumn("_c", c)

    def meet(qp: pd.DataFrame, tp: pd.DataFrame) -> pd.DataFrame:
        if not len(qp) or not len(tp):
            return pd.DataFrame({"qid": [], "nid": [], "dist": []}).astype({"qid": "int64", "nid": "int64", "dist": "float64"})
        ids = qp["id"].to_numpy()
        return emit(ids, *_nearest(np.stack(qp["x"].to_numpy()), ids, np.stack(tp["x"].to_numpy()), tp["id"].to_numpy(), k, skip_self))

    part = q.groupBy("_b", "_c").cogroup(t.groupBy("_b", "_c")).applyInPandas(meet, NEIGHBOUR_SCHEMA)
    best = part.groupBy("qid").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "nid"))), 1, k).alias("_n"))
    return best.select("qid", F.explode("_n").alias("_n")).select("qid", F.col("_n.nid").alias("nid"), F.col("_n.dist").alias("dist"))


class LofModel:
    def __init__(self, pre: Preprocessor | None, train: DataFrame, stats: DataFrame, k: int, cap: int):
        self.pre, self.train, self.stats, self.k, self.cap = pre, train, stats, k, cap

    def score_vectors(self, queries: DataFrame) -> DataFrame:
        """id and score for a table of (id, x)."""
        near = nearest_neighbours(queries, self.train, self.k, cap=self.cap)
        return density_ratio(near, self.stats)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        tagged = df.withColumn("_id", F.xxhash64(*self.key))
        s = self.score_vectors(tagged.select(F.col("_id").alias("id"), self.pre.vector().alias("x")))
        return tagged.join(s.select(F.col("id").alias("_id"), F.col("score").alias(name)), "_id", "left").drop("_id")


def density_ratio(near: DataFrame, stats: DataFrame) -> DataFrame:
    """Outlier factor from neighbour rows: mean neighbour density over own density."""
    s = stats.select(F.col("id").alias("nid"), "kdist", "lrd")
    return near.join(s, "nid").groupBy("qid").agg(
        F.avg(F.greatest("kdist", "dist")).alias("_reach"), F.avg("lrd").alias("_around")
    ).select(F.col("qid").alias("id"), (F.col("_around") * (F.col("_reach") + 1e-10)).alias("score"))


def fit_densities(train: DataFrame, k: int, cap: int) -> DataFrame:
    """k-distance and local reachability density of every training row."""
    near = materialise(nearest_neighbours(train, train, k, skip_self=True, cap=cap), "neighbours")
    kd = near.groupBy("qid").agg(F.max("dist").alias("kdist"))
    reach = near.join(kd.select(F.col("qid").alias("nid"), "kdist"), "nid").groupBy("qid").agg(
        (1.0 / (F.avg(F.greatest("kdist", "dist")) + 1e-10)).alias("lrd")
    )
    return materialise(kd.join(reach, "qid").withColumnRenamed("qid", "id"), "densities")


class LofScorer(Scorer):
    """Local outlier factor of new rows against the training rows, k = clamp(20, 2, n - 1)."""

    name = "LOF"

    def __init__(self, columns, key, neighbours: int = 20, cap: int = 20_000):
        super().__init__(columns, key)
        self.neighbours, self.cap = neighbours, cap

    def fit(self, train: DataFrame) -> LofModel:
        pre = Preprocessor(self.columns).fit(train)
        t = materialise(train.select(F.xxhash64(*self.key).alias("id"), pre.vector().alias("x")), "lof-train")
        return self.fit_vectors(t, pre)

    def fit_vectors(self, t: DataFrame, pre: Preprocessor | None = None) -> LofModel:
        k = max(2, min(self.neighbours, t.count() - 1))
        m = LofModel(pre, t, fit_densities(t, k, self.cap), k, self.cap)
        m.key = self.key
        return m


# Rows on which a task takes local steps in a round.
SHARD_ROWS = 20_000

# --- iterative learners: local steps per task, averaged every round ----------------------------


def _local_steps(step: Callable, r: int, held):
    """One round of a shard: its rows in hash order, its row count and new weights."""

    def run(key, pdf):
        m = np.stack(pdf.sort_values("_h", kind="stable")["x"].to_numpy())
        return pd.DataFrame([(key[0], len(m), step(held.value.copy(), m, r).tolist())], columns=["s", "n", "w"])

    return run


def averaged_rounds(train: DataFrame, start: np.ndarray, step: Callable, rounds: int, parts: int = 8, valid: Callable | None = None, patience: int = 3):
    """Weights averaged over tasks: every round each task takes local steps on its own rows.

    ``train`` (columns x and _h, a hash of the row's key) is written once, dealt by hash into shards of about ``SHARD_ROWS`` rows (at
    least ``parts`` shards) and ordered by hash within a shard, so the weights do not depend on how the
    table was laid out. ``valid`` maps weights to a validation loss; training stops after ``patience``
    rounds without gain.
    """
    shards = max(parts, -(-train.count() // SHARD_ROWS))
    d = materialise(train.select("x", "_h").withColumn("_s", F.pmod("_h", F.lit(shards))), "train")
    w, best, best_w, stale = start, np.inf, start, 0
    for r in range(rounds):
        held = d.sparkSession.sparkContext.broadcast(w)

        got = d.groupBy("_s").applyInPandas(_local_steps(step, r, held), "s long, n long, w array<double>").collect()  # one weight vector per shard
        got.sort(key=lambda g: g["s"])
        total = sum(g["n"] for g in got)
        w = sum(np.asarray(g["w"]) * (g["n"] / total) for g in got)
        if valid is None:
            best_w = w
            continue
        loss = valid(w)
        if loss < best - 1e-4:
            best, best_w, stale = loss, w, 0
        else:
            stale += 1
            if stale >= patience:
                break
    return best_w


class OneClassScorer(Scorer):
    """Margin to a one-class boundary in a random Fourier feature space of an RBF kernel."""

    name = "OneClassSVM"

    def __init__(self, columns, key, nu: float = 0.05, max_train: int | None = None, features: int = 256, rounds: int = 8, seed: int = 42):
        super().__init__(columns, key)
        self.nu, self.max_train, self.features, self.rounds, self.seed = nu, max_train, features, rounds, seed

    def fit(self, train: DataFrame) -> Model:
        pre = Preprocessor(self.columns).fit(train)
        t = hash_sample(train.select(*self.key, pre.vector().alias("x")), self.key, self.max_train, self.seed)
        d, nu, big = len(self.columns), self.nu, self.features
        n, s, g = moments(t.select("x"), d)
        var = float(np.trace(g) / (n * d) - (s.sum() / (n * d)) ** 2) or 1.0
        rng = np.random.default_rng(self.seed)
        freq = rng.normal(0.0, np.sqrt(2.0 / (d * var)), (d, big))
        shift = rng.uniform(0, 2 * np.pi, big)

        def lift(m):
            return np.sqrt(2.0 / big) * np.cos(m @ freq + shift)

        def step(w, m, r):
            z, rho = lift(m), w[-1]
            v = w[:-1]
            for it in range(40):
                lr = 0.5 / (1 + 0.1 * (it + 40 * r))
                out = z @ v < rho
                v = v - lr * (v - z[out].sum(0) / (nu * len(z)))
                rho = rho - lr * (out.mean() / nu - 1.0)
            return np.r_[v, rho]

        w = averaged_rounds(t.select("x", F.xxhash64(*self.key).alias("_h")), np.zeros(big + 1), step, self.rounds)
        v, rho = w[:-1], w[-1]
        return Model(pre, lambda m: rho - lift(m) @ v)


class AutoencoderScorer(Scorer):
    """Mean squared reconstruction error of a small ReLU network trained to repeat its input."""

    name = "MLP-AE"

    def __init__(self, columns, key, hidden=(16, 8, 16), max_train: int | None = None, rounds: int = 10, local_epochs: int = 10, seed: int = 42):
        super().__init__(columns, key)
        self.hidden, self.max_train, self.rounds, self.local_epochs, self.seed = hidden, max_train, rounds, local_epochs, seed

    def fit(self, train: DataFrame) -> Model:
        pre = Preprocessor(self.columns).fit(train)
        t = hash_sample(train.select(*self.key, pre.vector().alias("x")), self.key, self.max_train, self.seed)
        t = materialise(t.withColumn("_v", F.pmod(F.xxhash64(F.lit(self.seed + 1), *self.key), F.lit(10)) == 0), "mlp")
        sizes = [len(self.columns), *self.hidden, len(self.columns)]
        shapes = list(zip(sizes[:-1], sizes[1:]))
        rng = np.random.default_rng(self.seed)
        start = np.concatenate([np.r_[rng.normal(0, np.sqrt(2 / (a + b)), a * b), np.zeros(b)] for a, b in shapes])
        epochs, seed = self.local_epochs, self.seed

        def layers(w):
            out, p = [], 0
            for a, b in shapes:
                out.append((w[p : p + a * b].reshape(a, b), w[p + a * b : p + a * b + b]))
                p += a * b + b
            return out

        def forward(w, m):
            acts, ls = [m], layers(w)
            for k, (a, b) in enumerate(ls):
                z = acts[-1] @ a + b
                acts.append(np.maximum(z, 0) if k < len(ls) - 1 else z)
            return acts

        def gradient(w, m):
            acts, ls = forward(w, m), layers(w)
            delta = 2 * (acts[-1] - m) / m.size
            parts = []
            for k in range(len(ls) - 1, -1, -1):
                parts.append(np.r_[(acts[k].T @ delta).ravel(), delta.sum(0)])
                if k:
                    delta = (delta @ ls[k][0].T) * (acts[k] > 0)
            return np.concatenate(parts[::-1])

        def step(w, m, r):
            gen = np.random.default_rng([seed, r, len(m)])
            m1, m2, k = np.zeros_like(w), np.zeros_like(w), 0
            for _ in range(epochs):
                order = gen.permutation(len(m))
                for s in range(0, len(m), 64):
                    k += 1
                    gr = gradient(w, m[order[s : s + 64]])
                    m1, m2 = 0.9 * m1 + 0.1 * gr, 0.999 * m2 + 0.001 * gr * gr
                    w = w - 0.003 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
            return w

        held_out = t.where("_v").select("x")

        def valid(w):
            @F.pandas_udf("double")
            def err(x: pd.Series) -> pd.Series:
                a = np.stack(x.to_numpy())
                return pd.Series(((forward(w, a)[-1] - a) ** 2).mean(1))

            v = held_out.select(err("x").alias("e")).agg(F.avg("e").alias("e")).first()["e"]
            return float("inf") if v is None else float(v)

        w = averaged_rounds(t.where("NOT _v").select("x", F.xxhash64(*self.key).alias("_h")), start, step, self.rounds, valid=valid)
        return Model(pre, lambda m: ((forward(w, m)[-1] - m) ** 2).mean(1))


SMOKE = {c.name: c for c in (IsolationForestScorer, LofScorer, PcaScorer)}
BENCHMARK = {c.name: c for c in (IsolationForestScorer, LofScorer, OneClassScorer, PcaScorer, AutoencoderScorer)}


def score_all(train: DataFrame, df: DataFrame, columns: list[str], key: list[str], roster: dict | None = None) -> DataFrame:
    """Long score table: every scorer of the roster fitted on ``train`` and applied to ``df``."""
    out = None
    for name, cls in (roster or BENCHMARK).items():
        part = cls(columns, key).fit(train).score(df).withColumn("detector", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def family_ablation(windows: DataFrame, train_rows: Column, cls, key: list[str], sets: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Scores of one scorer refitted on each feature set; ``feature_set`` names the set."""
    out = None
    for name, cols in sets.items():
        part = cls(cols, key).fit(windows.where(train_rows)).score(windows).select(*keep, "score", F.lit(name).alias("feature_set"))
        out = part if out is None else out.unionByName(part)
    return out
