"""Registered source/sink round trips: data derived from the driver tables is
written to the shared scratch folder (spark.checkpoint.dir) and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlane.plans.registry import SQL_CORPUS, SQL_FX, register
from searchlane.session import scratch_path
from searchlane.sources import fixtures as fx
from searchlane.sources import io
from searchlane.sources.tables import Tables


@register("rollout_log_jsonl", sql=f"""
WITH {SQL_FX['sequences']}, {SQL_FX['rollout_log']}
SELECT split, "index", uid, data_source, score FROM rollout_log""")
def q_rollout_log_jsonl(spark, sf_dir):
    """S7 + S8 + S3: the scored rollout log written as JSON lines in two
    appended batches (train, then test) and read back with the tolerant reader."""
    log = fx.rollout_log(Tables(spark, sf_dir)).select("split", "index", "uid", "data_source", "score")
    path = scratch_path(spark, "rollout-log")
    io.write_jsonl(log.filter(F.col("split") == "train"), path)
    io.append_rollouts(log.filter(F.col("split") == "test"), path)
    good, _bad = io.read_rollout_log(spark, path)
    return good.select("split", "index", "uid", "data_source", "score")


@register("corpus_roundtrip", sql=f"""
WITH {SQL_CORPUS}
SELECT CAST(id AS VARCHAR) AS id, md5(contents) AS contents_md5 FROM corpus""")
def q_corpus_roundtrip(spark, sf_dir):
    """S6 + S4: passages written as a parquet split and read back through the
    corpus reader (required-column check, string ids)."""
    corpus = fx.corpus(Tables(spark, sf_dir))
    base = scratch_path(spark, "corpus")
    io.write_split(corpus, base, "train")
    back = io.read_corpus(spark, f"{base}/train.parquet")
    return back.select("id", F.md5("contents").alias("contents_md5"))


@register("embeddings_roundtrip", sql="""
SELECT vec_id AS doc_id, len(embedding)::BIGINT AS dim,
       round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS sq_norm
FROM embeddings""")
def q_embeddings_roundtrip(spark, sf_dir):
    """The embedding matrix written as (doc_id, array<float>) parquet and read back."""
    e = Tables(spark, sf_dir).embeddings
    path = scratch_path(spark, "embeddings")
    io.write_embeddings(e, path, id_col="vec_id")
    back = io.read_embeddings(spark, path)
    return back.select("doc_id", F.size("embedding").cast("long").alias("dim"),
                       F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 6)
                       .alias("sq_norm"))
