"""Corpus cleaning pipeline: documents in, packed training sequences out.

Stages, each over all that the one before kept: toxicity (rejected documents go), line dedup
(repeated lines go), MinHash near-dedup (one document of each group stays), secret scans (spans are
masked) and best-fit packing (rows of pieces with their places in sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegauge.llm.lines import dedup_lines
from wavegauge.llm.minhash import near_duplicates
from wavegauge.llm.packing import pack_documents
from wavegauge.llm.secrets import scan_secrets
from wavegauge.llm.toxicity import score_toxicity, train_toxicity
from wavegauge.session import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRY = ("lang", "source")
MASK = "[SECRET]"


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it now is."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from ``labels``."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model, keep=("text", *CARRY, "n_chars"))
    return scored.where(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; those that lose every line stay empty."""
    return _documents(dedup_lines(docs, keep=CARRY))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of every group of near duplicates (five-word shingles, 0.8)."""
    gone = near_duplicates(docs, k=5).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return _documents(scan_secrets(docs, keep=CARRY, redact=MASK))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash", minhash), ("secret_scan", secret_scan), ("packing", packing)]
# A trained classifier and tokenisation are beyond SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
