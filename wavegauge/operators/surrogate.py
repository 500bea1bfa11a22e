"""Configuration-to-KPI surrogates: folds, regressors, quantile forests and conformal intervals."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import draw, require_columns
from ..session import materialise
from .ranking import check_nominal, interval_coverage, regression_scores
from .scale import BROADCAST_ROWS, fits, grouped_quantiles, prefix_sum

# Fixed column names of a sweep and the canonical candidate values.
CONTROLLED = ["ttt_ms", "hyst_db", "a3_off_db"]
CONTEXT = [f"{m}_{q}_{u}" for m, u in (("rsrp", "dbm"), ("sinr", "db"), ("rsrq", "db")) for q in ("p10", "p50", "p90")]
FEATURES = [*CONTROLLED, *CONTEXT]
TARGETS = ["hosr", "rlf_rate", "ping_pong_rate"]
CANONICAL = {"ttt_ms": [256.0, 480.0, 1024.0], "hyst_db": [0.0, 1.0, 3.0, 6.0], "a3_off_db": [0.0, 3.0, 6.0]}


def check_sweep(sweep: DataFrame) -> DataFrame:
    require_columns(sweep, [*FEATURES, *TARGETS, "seed", "hofr_rate"], "sweep")
    return sweep.select("*").withColumns({c: F.col(c).cast("double") for c in [*FEATURES, *TARGETS, "hofr_rate"]})


def redundancy_report(sweep: DataFrame) -> DataFrame:
    """Largest deviation of hosr + hofr_rate from 1 and the number of rows above tolerance."""
    dev = F.abs(F.col("hosr") + F.col("hofr_rate") - 1.0)
    return sweep.agg(F.max(dev).alias("worst"), F.count(F.when(dev > 1e-6, 1)).alias("n_bad"), F.count(F.lit(1)).alias("n"))


def assert_redundant(sweep: DataFrame) -> None:
    row = redundancy_report(sweep).first()
    if row["n_bad"]:
        raise ValueError(f"hofr_rate is not 1 - hosr: {row['n_bad']} rows deviate, worst by {row['worst']:.6g}")


def grouped_folds(sweep: DataFrame, k: int = 5, keys: list[str] = CONTROLLED) -> DataFrame:
    """Add ``fold``: configurations, largest first, go to the lightest fold, so none is split."""
    counts = sweep.groupBy(*keys).count()
    if not fits(counts, BROADCAST_ROWS):
        raise ValueError("the configuration table is a dimension and must stay small")
    groups = sorted(counts.collect(), key=lambda g: (-g["count"], *[g[c] for c in keys]))  # one row per configuration
    if k > len(groups):
        raise ValueError(f"{k} folds need at least {k} configurations, found {len(groups)}")
    load, rows = [0] * k, []
    for g in groups:
        f = min(range(k), key=lambda j: (load[j], j))
        load[f] += g["count"]
        rows.append((*[float(g[c]) for c in keys], f))
    schema = ", ".join(f"{c} double" for c in keys) + ", fold int"
    return sweep.join(F.broadcast(sweep.sparkSession.createDataFrame(rows, schema)), keys)


def candidate_grid(spark, sweep: DataFrame | None = None) -> DataFrame:
    """Distinct configurations of a sweep, or the canonical grid."""
    if sweep is not None:
        return sweep.select(*[F.col(c).cast("double").alias(c) for c in CONTROLLED]).distinct()
    rows = [(t, h, a) for t in CANONICAL["ttt_ms"] for h in CANONICAL["hyst_db"] for a in CANONICAL["a3_off_db"]]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in CONTROLLED))


def median_context(sweep: DataFrame) -> DataFrame:
    """Median of every context column: one row."""
    q = grouped_quantiles(sweep, [], {c: {f"{c}__m": 0.5} for c in CONTEXT})
    return q.select(*[F.col(f"{c}__m").alias(c) for c in CONTEXT])


def _assemble(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="_x", handleInvalid="skip").transform(df)


def share(key: list[str], seed: str) -> Column:
    """Repeatable number in [0, 10000) per row key."""
    return draw(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in key]), F.lit(10_000))


class BoostedRegressor:
    """Gradient-boosted trees with a held-out share for early stopping."""

    name = "boosted"

    def __init__(self, iterations: int = 60, rate: float = 0.1, depth: int = 5, leaf: int = 5, key: list[str] | None = None):
        self.iterations, self.rate, self.depth, self.leaf = iterations, rate, depth, leaf
        self.key = key or [*CONTROLLED, "seed"]

    def fit(self, train: DataFrame, target: str) -> "BoostedRegressor":
        d = _assemble(train).where(F.col(target).isNotNull()).withColumn("_held", share(self.key, "valid") < 1000)
        d = d.select("_x", F.col(target).alias("_y"), "_held")
        gbt = GBTRegressor(
            featuresCol="_x", labelCol="_y", predictionCol=target, maxIter=self.iterations, stepSize=self.rate, maxDepth=self.depth,
            minInstancesPerNode=self.leaf, validationIndicatorCol="_held", seed=42,
        )
        self.target, self.model = target, gbt.fit(d)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        clean = df.drop(self.target)
        return self.model.transform(_assemble(clean)).drop("_x")


class QuantileForest:
    """Quantiles of the training targets that share leaves with a row, all trees weighted equally."""

    name = "quantile"

    def __init__(self, q_lo: float = 0.1, q_hi: float = 0.9, trees: int = 30, depth: int = 6, leaf: int = 5):
        if not (0 < q_lo < 0.5 < q_hi < 1):
            raise ValueError("need 0 < q_lo < 0.5 < q_hi < 1")
        self.q_lo, self.q_hi, self.trees, self.depth, self.leaf = q_lo, q_hi, trees, depth, leaf

    def fit(self, train: DataFrame, target: str) -> "QuantileForest":
        rf = RandomForestRegressor(
            featuresCol="_x", labelCol=target, predictionCol="_p", numTrees=self.trees, maxDepth=self.depth, minInstancesPerNode=self.leaf, seed=42
        )
        d = _assemble(train).where(F.col(target).isNotNull())
        self.target, self.model = target, rf.fit(d)
        self.model.setLeafCol("_leaf")
        leaves = self._leaves(d.select("_x", F.col(target).alias("_y")))
        counts = leaves.groupBy("_tree", "_node", "_y").agg(F.count(F.lit(1)).alias("_n"))
        size = leaves.groupBy("_tree", "_node").agg(F.count(F.lit(1)).alias("_size"))
        self.table = materialise(counts.join(size, ["_tree", "_node"]).withColumn("_w", F.col("_n") / F.col("_size")), "leaves")
        return self

    def _leaves(self, d: DataFrame) -> DataFrame:
        t = self.model.transform(d).select(*[c for c in d.columns if c != "_x"], F.posexplode(vector_to_array("_leaf")).alias("_tree", "_node"))
        return t.withColumn("_node", F.col("_node").cast("int"))

    def predict_interval(self, df: DataFrame) -> DataFrame:
        """Adds <target>_lo, <target> and <target>_hi, in ascending order."""
        t = self.target
        d = df.drop(t).withColumn("_row", F.xxhash64(*[F.col(c) for c in FEATURES]))
        keys = _assemble(d.select("_row", *FEATURES).dropDuplicates(["_row"])).select("_row", "_x")
        w = self._leaves(keys).join(self.table, ["_tree", "_node"]).groupBy("_row", "_y").agg(F.sum("_w").alias("_w"))
        r = prefix_sum(w, ["_row"], "_y", ["_w"])
        cut = lambda q: F.min(F.when(F.col("cum__w") >= F.lit(q) * F.col("tot__w") - 1e-9, F.col("_y")))
        q = r.groupBy("_row").agg(F.array_sort(F.array(cut(self.q_lo), cut(0.5), cut(self.q_hi))).alias("_q"))
        out = d.join(q, "_row", "left")
        return out.select(*df.drop(t).columns, F.col("_q")[0].alias(f"{t}_lo"), F.col("_q")[1].alias(t), F.col("_q")[2].alias(f"{t}_hi"))

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_interval(df).drop(f"{self.target}_lo", f"{self.target}_hi")


def conformal_margin(calibration: DataFrame, actual: str, low: str, high: str, nominal: float, keys: list[str] | None = None) -> DataFrame:
    """Widening per key: the corrected quantile of max(low - y, y - high) over the calibration rows."""
    check_nominal([nominal])
    keys = keys or []
    e = calibration.withColumn("_e", F.greatest(F.col(low) - F.col(actual), F.col(actual) - F.col(high))).where(F.col("_e").isNotNull())
    counts = materialise(e.groupBy(*keys, "_e").agg(F.count(F.lit(1)).alias("n")), "residuals")  # read several times by the running totals
    r = prefix_sum(counts, keys, "_e", ["n"])
    level = F.least(F.lit(1.0), F.ceil((F.col("tot_n") + 1) * F.lit(nominal)) / F.col("tot_n"))
    h = level * (F.col("tot_n") - 1)
    at = lambda k: F.max(F.when((F.col("cum_n") > k) & (F.col("cum_n") - F.col("n") <= k), F.col("_e")))
    g = r.groupBy(*keys).agg(at(F.floor(h)).alias("_a"), at(F.ceil(h)).alias("_b"), F.max(h - F.floor(h)).alias("_f"), F.max("tot_n").alias("n_calibration"))
    return g.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("margin"), "n_calibration")


class ConformalForest:
    """Quantile forest on one share of the rows, widened by what the other share needs."""

    name = "conformal"

    def __init__(self, q_lo: float = 0.1, q_hi: float = 0.9, calibration: float = 0.25, key: list[str] | None = None, **forest):
        if not 0.05 <= calibration <= 0.5:
            raise ValueError("calibration share must lie in [0.05, 0.5]")
        self.inner, self.calibration = QuantileForest(q_lo, q_hi, **forest), calibration
        self.key = key or [*CONTROLLED, "seed"]

    def fit(self, train: DataFrame, target: str) -> "ConformalForest":
        if train.limit(20).count() < 20:
            raise ValueError("at least 20 rows are needed to hold out a calibration share")
        held = share(self.key, "calibration") < int(self.calibration * 10_000)
        cal = train.where(held)
        self.target = target
        self.inner.fit(train.where(~held), target)
        y = cal.withColumn("_actual", F.col(target))
        nominal = self.inner.q_hi - self.inner.q_lo
        row = conformal_margin(self.inner.predict_interval(y), "_actual", f"{target}_lo", f"{target}_hi", nominal).first()
        if row is None or row["n_calibration"] < 5:
            raise ValueError("the calibration share holds fewer than 5 rows")
        self.margin = float(row["margin"])
        return self

    def predict_interval(self, df: DataFrame) -> DataFrame:
        t = self.target
        out = self.inner.predict_interval(df)
        return out.withColumns({f"{t}_lo": F.col(f"{t}_lo") - self.margin, f"{t}_hi": F.col(f"{t}_hi") + self.margin})

    def predict(self, df: DataFrame) -> DataFrame:
        return self.predict_interval(df).drop(f"{self.target}_lo", f"{self.target}_hi")


REGISTRY = {c.name: c for c in (BoostedRegressor, QuantileForest, ConformalForest)}


class Bundle:
    """One fitted model per target behind a single predict / predict_interval."""

    def __init__(self, models: dict[str, object], intervals: dict[str, object] | None = None):
        self.models, self.intervals = models, intervals or {}
        self.targets = list(models)

    def predict(self, df: DataFrame) -> DataFrame:
        for m in self.models.values():
            df = m.predict(df)
        return df

    def predict_interval(self, df: DataFrame) -> DataFrame:
        for t, m in self.intervals.items():
            point = f"_point_{t}"
            df = m.predict_interval(df.withColumnRenamed(t, point)).drop(t).withColumnRenamed(point, t)
        return df


def fit_per_target(factory, train: DataFrame, targets: list[str] = TARGETS) -> dict[str, object]:
    return {t: factory().fit(train, t) for t in targets}


class ExpressionSurrogate:
    """A surrogate given by SQL expressions over the feature columns."""

    def __init__(self, expressions: dict[str, str]):
        self.expressions, self.targets, self.intervals = expressions, list(expressions), {}

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumns({t: F.expr(e).cast("double") for t, e in self.expressions.items()})

    def predict_interval(self, df: DataFrame) -> DataFrame:
        return df


def cv_points(folded: DataFrame, factory, target: str, k: int = 5) -> DataFrame:
    """Out-of-fold predictions: fold, actual, predicted."""
    out = None
    for f in range(k):
        m = factory().fit(folded.where(F.col("fold") != f), target)
        test = folded.where(F.col("fold") == f).withColumn("actual", F.col(target))
        part = m.predict(test).select(F.lit(f).alias("fold"), F.lit(target).alias("target"), "actual", F.col(target).alias("predicted"))
        out = part if out is None else out.unionByName(part)
    return out


def cv_intervals(folded: DataFrame, factory, target: str, nominal: float, k: int = 5) -> DataFrame:
    """Out-of-fold intervals: fold, actual, low, high, nominal."""
    out = None
    for f in range(k):
        m = factory().fit(folded.where(F.col("fold") != f), target)
        test = folded.where(F.col("fold") == f).withColumn("actual", F.col(target))
        part = m.predict_interval(test).select(
            F.lit(f).alias("fold"), F.lit(target).alias("target"), F.lit(nominal).alias("nominal"), "actual", F.col(f"{target}_lo").alias("low"), F.col(f"{target}_hi").alias("high")
        )
        out = part if out is None else out.unionByName(part)
    return out


def aggregate_cv(predictions: DataFrame) -> DataFrame:
    """Mean and population deviation over folds of MAE, RMSE and R2 per target."""
    per = regression_scores(predictions, ["target", "fold"])
    aggs = [f(c).alias(f"{c}_{n}") for c in ("mae", "rmse", "r2") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return per.groupBy("target").agg(F.countDistinct("fold").alias("n_folds"), *aggs)


def aggregate_cv_coverage(intervals: DataFrame) -> DataFrame:
    per = interval_coverage(intervals, ["target", "fold"])
    return per.groupBy("target", "nominal").agg(
        F.countDistinct("fold").alias("n_folds"), F.avg("coverage").alias("empirical_mean"), F.stddev_pop("coverage").alias("empirical_std"), F.avg("mean_width").alias("width_mean")
    )


def surrogate_verdicts(points: DataFrame, coverage: DataFrame, n_feasible: DataFrame, n_targets: int = 3) -> DataFrame:
    """Acceptance rows C2..C5: hosr error, fit quality, interval coverage band and feasible count."""
    c2 = points.agg(F.max(F.when(F.col("target") == "hosr", F.col("mae_mean"))).alias("v")).select(F.lit("C2").alias("code"), "v", F.coalesce(F.col("v") <= 0.05, F.lit(False)).alias("passed"))
    c3 = points.agg(F.min("r2_mean").alias("v"), F.count(F.when(F.col("r2_mean") > 0.5, 1)).alias("k")).select(F.lit("C3").alias("code"), "v", (F.col("k") == n_targets).alias("passed"))
    ok = F.col("empirical_mean").between(0.70, 0.99)
    c4 = coverage.agg(F.min("empirical_mean").alias("v"), F.coalesce(F.min(ok.cast("int")), F.lit(0)).alias("k")).select(F.lit("C4").alias("code"), "v", (F.col("k") == 1).alias("passed"))
    c5 = n_feasible.agg(F.max("n_feasible").cast("double").alias("v")).select(F.lit("C5").alias("code"), "v", F.coalesce(F.col("v") >= 3, F.lit(False)).alias("passed"))
    return c2.unionByName(c3).unionByName(c4).unionByName(c5)
