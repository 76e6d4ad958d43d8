"""Readers and writers (S1-S11) with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROMPT_SCHEMA = T.StructType([
    T.StructField("data_source", T.StringType()),
    T.StructField("prompt", T.ArrayType(T.StructType([T.StructField("role", T.StringType()),
                                                      T.StructField("content", T.StringType())]))),
    T.StructField("ability", T.StringType()),
    T.StructField("reward_model", T.StructType([
        T.StructField("style", T.StringType()),
        T.StructField("ground_truth", T.StructType([T.StructField("target", T.ArrayType(T.StringType()))]))])),
    T.StructField("extra_info", T.StructType([T.StructField("split", T.StringType()),
                                              T.StructField("index", T.LongType())])),
])

CORPUS_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("contents", T.StringType())])

ROLLOUT_LOG_SCHEMA = T.StructType([
    T.StructField("split", T.StringType()), T.StructField("index", T.LongType()),
    T.StructField("uid", T.StringType()), T.StructField("sample_key", T.StringType()),
    T.StructField("data_source", T.StringType()), T.StructField("ground_truth", T.StringType()),
    T.StructField("prompt", T.StringType()), T.StructField("response", T.StringType()),
    T.StructField("full_sequence", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("error", T.StringType()),
])


def read_prompts(spark: SparkSession, paths: list[str] | str, schema: T.StructType = PROMPT_SCHEMA) -> DataFrame:
    """One or several parquet splits, concatenated, declared schema."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(schema).parquet(*paths)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, and a malformed line is an
    error when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_rollout_log(spark: SparkSession, path: str, schema: T.StructType = ROLLOUT_LOG_SCHEMA,
                     drop_errors: bool = True) -> tuple[DataFrame, DataFrame]:
    """S3: tolerant JSONL: malformed lines go to the ``bad`` frame (with the raw
    text) instead of failing; rows that carry an ``error`` are dropped from
    ``good`` when ``drop_errors``."""
    sch = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    row = F.from_json("value", sch, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    raw = lines.select(row.alias("r"), "value")  # each frame parses on its own: nothing is kept in memory
    bad = raw.filter(F.col("r._corrupt_record").isNotNull()).select(F.col("value").alias("_corrupt_record"))
    good = raw.filter(F.col("r._corrupt_record").isNull()).select("r.*").drop("_corrupt_record")
    if drop_errors and "error" in good.columns:
        good = good.filter(F.col("error").isNull() | (F.col("error") == ""))
    return good, bad


def read_corpus(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Passages (id, contents) from parquet shards or JSONL; both columns
    are required."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt in ("json", "jsonl"):
        df = spark.read.schema(CORPUS_SCHEMA).json(path)
    else:
        raise ValueError(fmt)
    missing = [c for c in ("id", "contents") if c not in df.columns]
    if missing:
        raise ValueError(f"corpus is missing required columns: {missing}")
    return df.select(F.col("id").cast("string"), "contents")


def write_split(df: DataFrame, out_dir: str, split: str | None = None, partition_by_split: bool = False) -> None:
    """Write a split as parquet (``<dir>/<split>.parquet``) or one dataset
    partitioned by the ``split`` column."""
    if partition_by_split:
        df.write.mode("overwrite").partitionBy("split").parquet(out_dir)
    else:
        df.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{split}.parquet")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, non-ASCII kept as UTF-8; ``mode='append'`` adds a
    batch of files next to earlier ones (append-only log)."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_rollouts(df: DataFrame, path: str) -> None:
    """S8."""
    write_jsonl(df, path, mode="append")


def write_embeddings(df: DataFrame, path: str, id_col: str = "doc_id", vec_col: str = "embedding") -> None:
    """(doc_id, embedding array<float>) parquet; row groups play the role
    of the reference's fixed-size chunks."""
    df.select(F.col(id_col).alias("doc_id"), F.col(vec_col).cast("array<float>").alias("embedding")) \
        .write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
