"""Nearest neighbours by a forest of hash prefixes (LSH forest).

Vectors are dealt into shards of bounded size by a hash of their id, queries into blocks
of bounded size; a cell is one shard and one block, so every query meets every shard and
no cell grows with the table. In a cell each of ``TREES`` trees is a sorted array of the
shard's ``BITS``-bit hash strings (signs of projections on seeded random directions). For
a query, every tree is descended to the longest prefix any string shares with it; then
all trees ascend together, bit by bit, until the matched ranges hold ``SHARE`` of the
shard's rows, counted with repeats over the trees. The candidates are scored by their
exact cosine in double precision on the original vectors (divided by a power of two, so
that tiny and huge components have a cosine too), a cell keeps its best ``k``,
and a window over the cells' rows picks each query's ``k``.

Trees are built from seeded directions, not fitted; every row is indexed. Recall against
brute force is measured in tests/llm. Candidates are a fixed share of a shard because
the nearest vectors of these tables lie far out (cosines near 0.45 in 64 dimensions), so
work grows with queries times rows, a stated query set in blocks.

Defined cases: vectors that are null, empty or zero or hold null or non-finite components
take no part; only vectors of one length are compared; a null id takes no part; rows that
repeat an id are compared as rows, but never with their own id; equal scores go to the
smaller id; fewer candidates than ``k`` give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlane.operators.common import top_k

NEAREST = 5
EVERY = 50
TREES = 48
BITS = 24
SHARE = 0.6
LEAST = 1024  # range rows a cell gathers at least, so that small tables are searched nearly whole
SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
SEED = 1234


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part, as arrays of doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
            .where(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v")))


def hashes(x: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """(trees, rows): each row's hash string in each tree, as an integer whose first bit is the highest."""
    directions = np.random.default_rng(SEED).standard_normal((x.shape[1], trees * bits))
    signs = (x @ directions > 0).reshape(len(x), trees, bits).astype(np.int64)
    return np.ascontiguousarray((signs << np.arange(bits - 1, -1, -1)).sum(axis=2).T)


class Forest:
    """Sorted arrays of hash strings, one a tree, over the rows of one shard."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.x, self.trees, self.bits = x, trees, bits
        h = hashes(x, trees, bits)
        self.order = np.argsort(h, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(h, self.order.astype(np.int64), axis=1)

    def ranges(self, q: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray]:
        """First and end place of the matched range in every tree, for every query (trees, queries)."""
        h = hashes(q, self.trees, self.bits)
        lo, hi = np.zeros_like(h), np.zeros_like(h)
        open_ = np.ones(len(q), bool)
        for length in range(self.bits, -1, -1):  # descend to the longest match, then ascend together
            if not open_.any():
                break
            drop = self.bits - length
            at = np.flatnonzero(open_)
            for t in range(self.trees):
                first = (h[t, at] >> drop) << drop
                lo[t, at] = np.searchsorted(self.sorted[t], first, "left")
                hi[t, at] = np.searchsorted(self.sorted[t], first + (1 << drop), "left")
            open_[at] = (hi[:, at] - lo[:, at]).sum(axis=0) < wanted
        return lo, hi

    def candidates(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(self.x), bool)
        for t in range(self.trees):
            mask[self.order[t, lo[t]:hi[t]]] = True
        return np.flatnonzero(mask)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by the power of two of their largest component: the cosine stays the same, to the bit
    unless a component vanishes beside it, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def search_cell(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, share: float,
                trees: int = TREES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the ``k`` best candidates of every query in one shard."""
    by_id = np.argsort(ids, kind="stable")  # so that a stable sort by score sends ties to the smaller id
    ids, x, q = ids[by_id], scaled(x[by_id]), scaled(q)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    forest = Forest(x, trees, bits)
    lo, hi = forest.ranges(q, max(share * len(x), LEAST, k + 1))
    q_norm = np.sqrt(np.einsum("ij,ij->i", q, q))
    out = ([], [], [])
    for j in range(len(q)):
        c = forest.candidates(lo[:, j], hi[:, j])
        c = c[ids[c] != query_ids[j]]
        score = np.einsum("ij,j->i", x[c], q[j]) / (norm[c] * q_norm[j])
        if len(c) > k:
            edge = np.partition(score, len(c) - k)[len(c) - k]
            near = np.flatnonzero(score >= edge)
            c, score = c[near], score[near]
        best = np.argsort(-score, kind="stable")[:k]
        out[0].append(np.full(len(best), query_ids[j]))
        out[1].append(ids[c[best]])
        out[2].append(score[best])
    return tuple(np.concatenate(o) if o else np.empty(0) for o in out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row of ``queries``."""
    rows, asked = usable(vectors), usable(queries)
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    # repeated ids differ in their values, so a hash of both deals hot ids out too
    spread = F.xxhash64("vec_id", "v")
    left = (rows.withColumn("shard", F.pmod(spread, F.lit(shards)))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (asked.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))))

    def cell(key, shard: pa.Table, block: pa.Table) -> pa.Table:
        dim = key[2].as_py()
        found = ([], [], [])
        if shard.num_rows and block.num_rows:
            found = search_cell(shard["vec_id"].to_numpy(), _matrix(shard["v"], dim),
                                block["vec_id"].to_numpy(), _matrix(block["v"], dim), k, share)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()),
                         "score": pa.array(found[2], pa.float64())})

    keys = ("shard", "block", "dim")
    best = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
            .applyInArrow(cell, "query_id long, vec_id long, score double"))
    return (top_k(best, ["query_id"], [F.desc("score"), F.col("vec_id")], k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op6_prefix_forest(spark, sf_dir):
    """Op 6 over the whole ``embeddings`` table; the queries are the rows whose id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
