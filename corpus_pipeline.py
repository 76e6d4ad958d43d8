"""A training-corpus pipeline over ``documents``: five filters and transforms in a row.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes each
result as Parquet in the shared folder and hands the reread table to the next stage. All
stages but the last return the columns of ``documents``; the last returns the mixture.
Null texts count as empty, null ids and repeated rows are kept as the operators define it,
an empty table passes through, and extra columns travel along unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlane.llm import scratch
from searchlane.llm.op3_substring_dedup import substring_dedup
from searchlane.llm.op5_simhash_golay import keep_one
from searchlane.llm.op7_suffix_decontam import decontaminate
from searchlane.llm.op8_mix_sources import mix
from searchlane.llm.op9_weak_toxicity import toxicity


def _as(docs: DataFrame, changed: DataFrame, **columns) -> DataFrame:
    """``changed`` (doc_id, text, ..., rest) with the columns of ``docs``; ``columns`` override."""
    take = {c: F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c) for c in docs.columns} | {
        c: v for c, v in columns.items() if c in docs.columns}
    return changed.select(*[take[c].alias(c) for c in docs.columns])


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weak supervision scores below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _as(docs, toxicity(docs, labels).where("score < 0.5"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each SimHash group."""
    return keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word spans that an earlier document holds; other texts keep their layout."""
    out = substring_dedup(docs, layout=True)
    return _as(docs, out.withColumn("text", F.col("kept_text")),
               n_chars=F.length("kept_text").cast("long"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim benchmark window."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and the words the mixture takes."""
    return mix(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", remove_near_copies),
    ("substring_dedup", remove_repeats),
    ("benchmark_decontamination", remove_contaminated),
    ("mix_sources", mix_to_targets),
]

#: SQL expresses neither the trained classifier nor fingerprints; tests/llm compares with a brute-force run
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
