"""Tables an operator writes on its way, in the folder named by ``spark.checkpoint.dir``.

Files in a shared folder survive lost executors, cut the lineage and, unlike an
RDD checkpoint, stay columnar and compressed.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlane.session import register_scratch_table, scratch_path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def store_bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Write ``df`` hash-dealt by ``key`` into ``n`` buckets, so that later joins on
    ``key`` move only the other side."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    path = scratch_path(spark, table)
    (df.repartition(n, key).write.option("path", path).bucketBy(n, key).saveAsTable(table))
    register_scratch_table(table, path)
    return spark.table(table)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`store` whose rows nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_scratch_path", None)
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs: it does so when
    the driver collects the garbage that still refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_partitions(df: DataFrame) -> int:
    """Input splits of a scan: they follow the bytes of the input."""
    return max(1, df.rdd.getNumPartitions())


def unless_present(df: DataFrame, column: str, kind: str):
    """``column`` as ``kind``, or typed nulls where the table lacks it."""
    return F.col(column).cast(kind) if column in df.columns else F.lit(None).cast(kind)
