"""Shared helpers for operators: size-checked broadcast and ordered top-k."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows under which a side is broadcast. Above it the planner's shuffle join is
# used (AQE may still switch to broadcast at runtime from real sizes).
DEFAULT_BROADCAST_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      proxy: DataFrame | None = None, per_row: int = 1) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows.

    The proof counts ``proxy`` (a cheap input whose row count times
    ``per_row`` bounds ``df``, e.g. queries x k for a top-k hit list) or ``df``
    itself; beyond the bound the DataFrame is returned unchanged and the join
    shuffles (AQE may still pick broadcast from measured stage sizes).
    """
    src = proxy if proxy is not None else df
    limit = max_rows // max(per_row, 1)
    n = src.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out if it has fewer input splits than the cluster has cores: such a table
    holds at most a few splits of text, which one task each would work on alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


# models a Python worker has loaded; the module stays with the worker from task to task
_LOADED: dict[str, object] = {}


def object_key(factory) -> str:
    """Name of a model factory by its pickled content: equal factories share a loaded model,
    different ones never do."""
    from pyspark import cloudpickle
    return hashlib.md5(cloudpickle.dumps(factory)).hexdigest()


def worker_object(key: str, load):
    """The object loaded under ``key``, once per Python worker."""
    if key not in _LOADED:
        _LOADED[key] = load()
    return _LOADED[key]


def top_k(df: DataFrame, partition_cols: list[str], order_cols: list[Column], k: int,
          rank_col: str = "rank") -> DataFrame:
    """Top-k per group with ``row_number``; Spark plans a partial
    ``WindowGroupLimit`` before the exchange, so a hot group ships at most
    k rows per map partition instead of all its candidates."""
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def ordered_collect(col_struct: Column, order_field: str) -> Column:
    """collect_list is unordered: sort the collected structs by their first field."""
    return F.array_sort(F.collect_list(col_struct))
