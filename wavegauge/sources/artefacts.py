"""Result sinks, upserts, file fingerprints and run summaries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import null_safe_join
from .digests import PIECE, UNPACKED, escape_glob, sha256_in_pieces

WHOLE = 64 << 20  # bytes up to which a task reads a file at once
PIPELINES = ["anomaly", "drift", "adaptive", "demo"]
SUMMARY_SCHEMA = """
winning_detector_by_per_type_mean_pr_auc string, winning_detector_by_mean_pr_auc string, winning_detector_by_overall_pr_auc string,
winning_detector string, n_detections double, n_drifts double, elapsed_s double,
strategies array<struct<strategy:string, overall_pr_auc:double, drift_phase_pr_auc:double, cost__n_refits:double, cost__fit_cpu_s_sum:double>>,
cumulative_predicted_uplift struct<hosr:double, rlf_rate:double>, n_interventions double, n_retrains double,
acceptance map<string, struct<pass:boolean>>
"""


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_json_summary(df: DataFrame, path: str) -> None:
    """A summary is one row; its columns become one JSON document."""
    df.coalesce(1).write.mode("errorifexists").json(path)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keep old rows whose key is not in ``new``, add the new rows; columns may differ."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def fingerprint(spark: SparkSession, roots: list[str], extensions: list[str] | None = None, excluded: list[str] | None = None, whole: int = WHOLE, piece: int = PIECE) -> DataFrame:
    """SHA-256 per file below the roots: path, size, sha256.

    Files may be filtered by extension, and dropped when a path component is excluded. Files beyond ``whole`` bytes
    are read at once, by this call, in pieces of ``piece`` bytes: one file's pieces in turn, different files side by side.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    if extensions:
        ok = F.lit(False)
        for e in extensions:
            ok = ok | F.col("path").endswith(e)
        d = d.where(ok)
    for part in excluded or []:
        d = d.where(~F.array_contains(F.split("path", "/"), part))
    digest = ["path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")]
    out = d.where(F.col("length") <= whole).select(*digest)
    long = [tuple(r) for r in d.where(F.col("length") > whole).select("path", "length").collect()]
    packed = [path for path, _ in long if path.endswith(UNPACKED)]
    if packed:
        out = out.unionByName(spark.read.format("binaryFile").load([escape_glob(p) for p in packed]).select(*digest))
    long = [(path, size) for path, size in long if not path.endswith(UNPACKED)]
    if long:
        with ThreadPoolExecutor(min(len(long), spark.sparkContext.defaultParallelism)) as pool:
            found = [pool.submit(inheritable_thread_target(spark)(sha256_in_pieces), spark, path, size, piece) for path, size in long]
            rows = [(path, size, f.result()) for (path, size), f in zip(long, found)]
        out = out.unionByName(spark.createDataFrame(rows, "path string, size long, sha256 string"))
    return out


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """OK, MISSING or MISMATCH per manifest entry; files outside the manifest are ignored."""
    found = files.select("path", F.col("sha256").alias("_got"))
    status = F.when(F.col("_got").isNull(), "MISSING").when(F.col("_got") == F.col("sha256"), "OK").otherwise("MISMATCH")
    return manifest.join(found, "path", "left").select("path", status.alias("status"))


def flatten_summaries(docs: DataFrame, overall_ap: DataFrame | None = None, expected: list[str] = PIPELINES) -> DataFrame:
    """Run summaries (run, pipeline, doc as JSON text) to rows (run, metric, num, txt, kind).

    Pipelines a run lacks give ``<pipeline>__missing``. Older documents name the per-type winner
    differently; the overall winner may be taken from a table (run, detector, pr_auc).
    """
    s = docs.select("run", "pipeline", F.from_json("doc", SUMMARY_SCHEMA).alias("s"))
    if overall_ap is not None:
        best = overall_ap.groupBy("run").agg(F.max_by("detector", "pr_auc").alias("_best"))
        s = null_safe_join(s, best, ["run"])
    else:
        s = s.withColumn("_best", F.lit(None).cast("string"))
    per_type = F.coalesce("s.winning_detector_by_per_type_mean_pr_auc", "s.winning_detector_by_mean_pr_auc")

    def entry(metric, num=None, txt=None, kind="number"):
        return F.struct(
            F.lit(metric).alias("metric") if isinstance(metric, str) else metric.alias("metric"),
            (num.cast("double") if num is not None else F.lit(None).cast("double")).alias("num"),
            (txt if txt is not None else F.lit(None).cast("string")).alias("txt"),
            F.lit(kind).alias("kind"),
        )

    text = lambda m, c: entry(m, txt=c, kind="text")
    fixed = {
        "anomaly": [
            text("anomaly__winning_detector_per_type_mean", per_type),
            text("anomaly__winning_detector_overall", F.coalesce("s.winning_detector_by_overall_pr_auc", "_best")),
            text("anomaly__winning_detector", per_type),
            entry("anomaly__elapsed_s", F.col("s.elapsed_s")),
        ],
        "drift": [text("drift__winning_detector", F.col("s.winning_detector"))]
        + [entry(f"drift__{c}", F.col(f"s.{c}")) for c in ("n_detections", "n_drifts", "elapsed_s")],
        "demo": [
            entry("demo__cum_uplift_hosr", F.col("s.cumulative_predicted_uplift.hosr")),
            entry("demo__cum_uplift_rlf_rate", F.col("s.cumulative_predicted_uplift.rlf_rate")),
            entry("demo__n_interventions", F.col("s.n_interventions")),
            entry("demo__n_retrains", F.col("s.n_retrains")),
        ],
    }
    strategies = F.flatten(
        F.transform(
            F.coalesce("s.strategies", F.array().cast("array<struct<strategy:string,overall_pr_auc:double,drift_phase_pr_auc:double,cost__n_refits:double,cost__fit_cpu_s_sum:double>>")),
            lambda x: F.array(
                *[
                    entry(F.concat(F.lit("adaptive__"), F.coalesce(x["strategy"], F.lit("unknown")), F.lit(f"__{out}")), x[src])
                    for out, src in (("overall_pr_auc", "overall_pr_auc"), ("drift_phase_pr_auc", "drift_phase_pr_auc"), ("n_refits", "cost__n_refits"), ("fit_cpu_s_sum", "cost__fit_cpu_s_sum"))
                ]
            ),
        )
    )
    accepted = F.transform(
        F.map_entries(F.coalesce("s.acceptance", F.create_map().cast("map<string,struct<pass:boolean>>"))),
        lambda x: entry(F.concat(F.lit("demo__acceptance__"), x["key"]), x["value"]["pass"], kind="bool"),
    )
    rows = (
        F.when(F.col("pipeline") == "anomaly", F.array(*fixed["anomaly"]))
        .when(F.col("pipeline") == "drift", F.array(*fixed["drift"]))
        .when(F.col("pipeline") == "adaptive", strategies)
        .when(F.col("pipeline") == "demo", F.concat(F.array(*fixed["demo"]), accepted))
    )
    long = s.select("run", F.explode(rows).alias("_r")).select("run", "_r.*")
    pick = lambda m: F.max(F.when(F.col("metric") == f"adaptive__drift_triggered_{m}__drift_phase_pr_auc", F.col("num")))
    delta = long.groupBy("run").agg((pick("filtered") - pick("naive")).alias("num")).where(F.col("num").isNotNull())
    delta = delta.select("run", F.lit("adaptive__delta_filtered_minus_naive").alias("metric"), "num", F.lit(None).cast("string").alias("txt"), F.lit("number").alias("kind"))
    have = docs.groupBy("run").agg(F.collect_set("pipeline").alias("_p"))
    lack = have.select("run", F.explode(F.array_except(F.array(*[F.lit(p) for p in expected]), "_p")).alias("_m"))
    missing = lack.select("run", F.concat("_m", F.lit("__missing")).alias("metric"), F.lit(1.0).alias("num"), F.lit(None).cast("string").alias("txt"), F.lit("bool").alias("kind"))
    return long.unionByName(delta).unionByName(missing)
