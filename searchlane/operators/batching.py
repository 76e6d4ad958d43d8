"""Batching, repetition, padding and length-balanced partitioning.

Global row order: range sort written once, then per-partition offsets (one row per
partition) added to ``monotonically_increasing_id`` positions, all JVM-side.
Balancing runs per training batch in ``applyInPandas`` (a batch is bounded by
design: fixed-size mini-batches).
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlane.session import materialise


def with_row_index(df: DataFrame, order_by: list, name: str = "row_idx") -> DataFrame:
    """Dense 0-based index in ``order_by`` order, JVM-side and distributed.

    The range-sorted rows are written once with their (partition, position), as
    ``monotonically_increasing_id`` gives them. Counts per partition, turned into
    running offsets, come from that same table, so rows and offsets can't disagree
    whatever the planner does: index = offset + position. No row passes through
    Python and no window spans the whole table.
    """
    placed = materialise(df.orderBy(*order_by).withColumn("_mid", F.monotonically_increasing_id()), "row_index")
    placed = (placed.withColumn("_part", F.shiftright("_mid", 33))
              .withColumn("_pos", F.col("_mid").bitwiseAND((1 << 33) - 1)))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: the offsets table is tiny whatever the data size
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).select("_part", "_off")
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, (F.col("_off") + F.col("_pos")).cast("long"))
            .drop("_mid", "_part", "_pos", "_off"))


def pop_columns(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, the others); a missing name is an error."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such column to take out: {missing}")
    return df.select(*[f"`{n}`" for n in names]), df.select(*[f"`{c}`" for c in df.columns if c not in names])


def select_rows(df: DataFrame, mask) -> DataFrame:
    """Rows whose boolean mask is true; a null mask is an error, as it selects nothing
    definite."""
    m = mask if not isinstance(mask, str) else F.col(mask)
    checked = F.when(m.isNull(), F.raise_error(F.lit("the mask of a row is null")).cast("boolean")).otherwise(m)
    return df.where(checked)


def repeat_rows(df: DataFrame, n: int, interleave: bool = True, row_col: str = "row_idx") -> DataFrame:
    """Each row n times; order key (row, i) interleaved or (i, row) tiled."""
    out = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    keys = [F.col(row_col), F.col("rep")] if interleave else [F.col("rep"), F.col(row_col)]
    return out.withColumn("repeat_order", F.struct(*keys))


def concat_batches(*dfs: DataFrame) -> DataFrame:
    """W5."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def chunk(df: DataFrame, n_chunks: int, row_col: str = "row_idx") -> DataFrame:
    """Split into equal chunks; a count not divisible by n is an error."""
    total = df.count()
    if total % n_chunks:
        raise ValueError(f"batch of {total} not divisible into {n_chunks} chunks")
    size = total // n_chunks
    return df.withColumn("chunk_id", F.floor(F.col(row_col) / size).cast("long"))


def mini_batches(df: DataFrame, size: int, row_col: str = "row_idx") -> DataFrame:
    """Fixed-size mini-batches by global row index."""
    return df.withColumn("batch_id", F.floor(F.col(row_col) / size).cast("long"))


def pad_to_divisor(df: DataFrame, divisor: int, row_col: str = "row_idx") -> DataFrame:
    """Append copies of the first r rows (tagged ``is_pad``) so the count is
    a multiple of ``divisor``; drop them later with ``filter(~is_pad)``."""
    total = df.count()
    r = (-total) % divisor
    base = df.withColumn("is_pad", F.lit(False))
    if r == 0:
        return base
    pad = (df.filter(F.col(row_col) < r)
           .withColumn(row_col, F.col(row_col) + total).withColumn("is_pad", F.lit(True)))
    return base.unionByName(pad)


# ------------------------------------------------------------- W8 / W9 / W11
def karmarkar_karp(lengths: list[int], k: int, equal_size: bool) -> list[list[int]]:
    """Largest differencing method: partitions of item indices with balanced sums."""
    if equal_size and len(lengths) % k:
        raise ValueError(f"{len(lengths)} items cannot form {k} equal-size partitions")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    heap = []
    if equal_size:
        for s in range(0, len(order), k):
            group = order[s:s + k]
            parts = [[i] for i in group]
            sums = [lengths[i] for i in group]
            heapq.heappush(heap, _state(parts, sums, s))
    else:
        for i in order:
            parts = [[i]] + [[] for _ in range(k - 1)]
            sums = [lengths[i]] + [0] * (k - 1)
            heapq.heappush(heap, _state(parts, sums, i))
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        sa = sorted(zip(a[1], a[0]), key=lambda x: x[0], reverse=True)
        sb = sorted(zip(b[1], b[0]), key=lambda x: x[0])
        parts = [pa + pb for (_, pa), (_, pb) in zip(sa, sb)]
        sums = [xa + xb for (xa, _), (xb, _) in zip(sa, sb)]
        heapq.heappush(heap, _state(parts, sums, min(min(p) for p in parts if p)))
    return heap[0][2][0]


def _state(parts, sums, tie):
    spread = max(sums) - min(sums)
    return (-spread, tie, (parts, sums))


def greedy_partition(lengths: list[int], k: int) -> list[list[int]]:
    """Items in arrival order to the currently least-loaded bin."""
    bins = [(0, j) for j in range(k)]
    out = [[] for _ in range(k)]
    heapq.heapify(bins)
    for i, n in enumerate(lengths):
        load, j = heapq.heappop(bins)
        out[j].append(i)
        heapq.heappush(bins, (load + n, j))
    return out


def balance_partitions(df: DataFrame, k: int, len_col: str = "seqlen", batch_col: str = "batch_id",
                       row_col: str = "row_idx", equal_size: bool = True, method: str = "kk") -> DataFrame:
    """Assign every row of each batch to one of k balanced partitions
    (``partition_id``); each row appears exactly once."""
    schema = T.StructType([T.StructField(batch_col, T.LongType()), T.StructField(row_col, T.LongType()),
                           T.StructField("partition_id", T.IntegerType())])

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_col)
        lens = pdf[len_col].astype(int).tolist()
        parts = karmarkar_karp(lens, k, equal_size) if method == "kk" else greedy_partition(lens, k)
        pid = [0] * len(lens)
        for j, p in enumerate(sorted(parts, key=lambda p: (min(p) if p else 1 << 60))):
            for i in p:
                pid[i] = j
        return pd.DataFrame({batch_col: pdf[batch_col].astype("int64").values,
                             row_col: pdf[row_col].astype("int64").values, "partition_id": pid})

    src = df.select(F.col(batch_col).cast("long"), F.col(row_col).cast("long"), F.col(len_col))
    return src.groupBy(batch_col).applyInPandas(assign, schema)


def balance_report(assigned: DataFrame, df: DataFrame, len_col: str = "seqlen",
                   batch_col: str = "batch_id", row_col: str = "row_idx") -> DataFrame:
    """W8 report: min / max / mean partition token sum per batch."""
    j = assigned.join(df.select(F.col(batch_col).cast("long"), F.col(row_col).cast("long"), len_col),
                      [batch_col, row_col])
    sums = j.groupBy(batch_col, "partition_id").agg(F.sum(len_col).alias("tokens"))
    return sums.groupBy(batch_col).agg(F.min("tokens").alias("min_tokens"), F.max("tokens").alias("max_tokens"),
                                       F.avg("tokens").alias("mean_tokens"))


def micro_batch_count(df: DataFrame, budget: int, len_col: str = "seqlen", batch_col: str = "batch_id") -> DataFrame:
    """ceil(total tokens / budget) micro-batches per batch."""
    return df.groupBy(batch_col).agg(F.ceil(F.sum(len_col) / budget).cast("int").alias("n_micro"))


def restore_order(df: DataFrame, row_col: str = "row_idx") -> DataFrame:
    """Undo any reordering by the carried row id."""
    return df.orderBy(row_col)


def snake_deal(df: DataFrame, k: int, len_col: str = "seqlen", key: str = "row_id") -> DataFrame:
    """Whole-table balancing: rank by length (range-sorted, distributed index)
    and deal ranks to k partitions in snake order (0..k-1, k-1..0, ...)."""
    idx = with_row_index(df, [F.col(len_col).desc(), F.col(key)], "_r")
    r = F.col("_r")
    lap = F.floor(r / k)
    pos = r % k
    return idx.withColumn("partition_id", F.when(lap % 2 == 0, pos).otherwise(k - 1 - pos).cast("int")).drop("_r")


def snake_batches(df: DataFrame, k: int, len_col: str = "seqlen", batch_col: str = "batch_id",
                  row_col: str = "row_idx") -> DataFrame:
    """W8/W11 by windows: the rows of each (bounded) batch, ranked by length, are dealt to k
    partitions in snake order; sizes differ by one row at most. Returns (batch, row, partition_id)."""
    r = F.row_number().over(Window.partitionBy(batch_col).orderBy(F.col(len_col).desc(), F.col(row_col))) - 1
    pos = F.col("_r") % k
    return (df.withColumn("_r", r).select(
        F.col(batch_col).cast("long"), F.col(row_col).cast("long"),
        F.when(F.floor(F.col("_r") / k) % 2 == 0, pos).otherwise(k - 1 - pos).cast("int").alias("partition_id")))


__all__ = ["with_row_index", "repeat_rows", "concat_batches", "chunk", "mini_batches", "pad_to_divisor",
           "karmarkar_karp", "greedy_partition", "balance_partitions", "balance_report",
           "micro_batch_count", "restore_order", "snake_batches", "snake_deal", "Window"]
