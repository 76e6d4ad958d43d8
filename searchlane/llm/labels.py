"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str, folds: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``remainder`` (a null id: never)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == remainder, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, remainder: int,
                    per_class: int) -> DataFrame:
    """(doc_id, y, text) of at most ``per_class`` labelled training documents of each class,
    picked by a hash of the id. Ids of the sample are a broadcast of bounded size, so
    other texts don't move. A document with several labels takes the largest, an id of
    several rows its largest text, so that no id brings more than one row; null labels and
    null ids are left out."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("doc_id", folds, remainder))
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text")))
