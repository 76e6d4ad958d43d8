"""Dense retrieval: encoding (V3), pooling (V4), normalisation (V5), exact
inner-product top-k (V6) and an approximate cell index (V7).

Exact search deals the vectors, each once, into shards of bounded size. A task holds one
shard as a matrix and lets the queries stream through it in blocks, keeping each query's k
best; a window merges the shards. The bytes of vectors moved do not depend on the number
of queries, nothing is collected or broadcast, and no (query, vector) pair is ever a row.

The cell index is a table partitioned by k-means cell: each vector's residual from its
cell's centre as one signed byte a component, with the original beside it in a column of
its own. A search prunes the partitions to the probed cells, scores the bytes, keeps every
vector whose score could still be among the k best given the rounding of its bytes, and
scores only those exactly. Within the probed cells the result is exact.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlane.functions.text import _c, encoder_input
from searchlane.operators.common import object_key, top_k, worker_object
from searchlane.session import materialise, scratch_path

SCORE_DIGITS = 6


# --------------------------------------------------------------------- V5 / V4
def l2_normalize(col) -> Column:
    """V5: v / ||v|| (a zero vector stays zero)."""
    c = _c(col)
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(c, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def pool(hidden, mask, method: str = "mean", pooler=None) -> Column:
    """V4: pool a (tokens x dim) array<array<float>> with its attention mask.

    ``mean`` = masked mean over tokens, ``cls`` = first token, ``pooler`` = a
    precomputed pooler-output column; anything else is an error.
    """
    h, m = _c(hidden), _c(mask)
    if method == "mean":
        dim = F.size(F.element_at(h, 1))
        n = F.aggregate(m, F.lit(0.0), lambda a, x: a + x)
        z = F.arrays_zip(h.alias("v"), m.alias("m"))
        return F.transform(F.sequence(F.lit(1), dim), lambda j: F.aggregate(
            z, F.lit(0.0), lambda a, e: a + F.element_at(e["v"], j) * e["m"]) / n)
    if method == "cls":
        return F.element_at(h, 1)
    if method == "pooler":
        if pooler is None:
            raise ValueError("pooler method needs the pooler output column")
        return _c(pooler)
    raise NotImplementedError(f"no pooling named {method!r}")


def default_pooling(model_name: str) -> str:
    n = model_name.lower()
    if "e5" in n or "contriever" in n:
        return "mean"
    if "bge" in n or "dpr" in n:
        return "cls" if "bge" in n else "pooler"
    return "mean"


# --------------------------------------------------------------------- V3
class HashingEncoder:
    """Deterministic test encoder: signed feature hashing of lower-cased word
    tokens into ``dim`` buckets, L2-normalised, float32. Any object with
    ``encode(list[str], is_query) -> np.ndarray`` can replace it."""

    def __init__(self, dim: int = 64, normalize: bool = True):
        self.dim = dim
        self.normalize = normalize

    def load(self):
        return self

    def encode(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        import re
        codes: dict[str, int] = {}  # every distinct word is hashed once
        words = [[codes.setdefault(w, len(codes)) for w in re.findall(r"[^\W_]+", (t or "").lower())] for t in texts]
        hashes = [hashlib.md5(w.encode("utf-8")).digest() for w in codes]
        bucket = np.array([int.from_bytes(h[:4], "little") % self.dim for h in hashes], np.int64)
        sign = np.array([1.0 if h[4] & 1 else -1.0 for h in hashes])
        code = np.fromiter((c for of in words for c in of), np.int64)
        row = np.repeat(np.arange(len(texts)), [len(of) for of in words])
        out = np.bincount(row * self.dim + bucket[code], sign[code], len(texts) * self.dim) \
            .reshape(len(texts), self.dim).astype(np.float32)  # whole numbers: exact in any order
        if self.normalize:
            n = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.where(n > 0, out / np.where(n > 0, n, 1), out)
        return out


def encode_texts(df: DataFrame, encoder=None, id_col: str = "id", text_col: str = "contents",
                 is_query: bool = False, model_name: str = "hash", batch_size: int = 512) -> DataFrame:
    """V3: (id, embedding array<float>) with the model's input prefix applied
    JVM-side first; Spark forms batches of ``batch_size`` rows, and each worker loads the
    encoder once (``predict_batch_udf``). A null text is encoded as an empty one."""
    from pyspark.ml.functions import predict_batch_udf
    factory = encoder if callable(encoder) and not hasattr(encoder, "encode") else (
        (lambda e=encoder: e) if encoder is not None else HashingEncoder)
    key = object_key(factory)

    def make():
        enc = worker_object(key, lambda: factory().load())
        return lambda texts: np.asarray(enc.encode(list(texts), is_query), np.float32)

    encode = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    text = F.coalesce(encoder_input(text_col, model_name, is_query), F.lit(""))
    return df.select(F.col(id_col).alias("id"), encode(text).alias("embedding"))


# --------------------------------------------------------------------- V6
SHARD_ROWS = 8192       # vectors that a task holds at once
BLOCK_QUERIES = 1024    # queries of one product: its scores are at most 64 MB


def _matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column of one length as a matrix, without per-row Python."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _first_k(at_q: np.ndarray, at_v: np.ndarray, got: np.ndarray, k: int):
    """The k best of each query by (score desc, place asc)."""
    order = np.lexsort((at_v, -got, at_q))
    at_q, at_v, got = at_q[order], at_v[order], got[order]
    keep = np.arange(len(at_q)) - np.searchsorted(at_q, at_q) < k
    return at_q[keep], at_v[keep], got[keep]


def _edge(scores: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th largest score."""
    at = scores.shape[1] - min(k, scores.shape[1])
    return np.partition(scores, at, axis=1)[:, at, None]


def _shard_top_k(k: int):
    """Every query's ``k`` best rows of a shard by (score desc, id asc)."""
    def held(shard: pa.Table):
        ids = shard["id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")
        return ids[by_id], _matrix(shard["v"], len(shard["v"][0]))[by_id]

    def score(state, block: pa.Table) -> dict:
        ids, v = state
        scores = np.round(_matrix(block["v"], v.shape[1]) @ v.T, SCORE_DIGITS)
        at_q, at_v = np.nonzero(scores >= _edge(scores, k))
        at_q, at_v, got = _first_k(at_q, at_v, scores[at_q, at_v], k)
        return {"query_id": block["id"].to_numpy()[at_q], "doc_id": ids[at_v], "score": got}

    return held, score


def _streamed(vectors: DataFrame, queries: DataFrame, held, score, schema: str) -> DataFrame:
    """Queries streamed past vectors, by ``key``: both sides (key, id, v, ...) meet in one
    partition, sorted so that a key's vectors, a bounded number, come before its queries,
    which are taken ``BLOCK_QUERIES`` at a time. ``held`` turns the vectors into a task's
    state and ``score`` a block of queries into rows of ``schema``."""
    def rows(batches):
        key, shard, state, made = None, [], None, pa.schema(fields)
        for batch in batches:
            mark = pc.binary_join_element_wise(batch.column("key"), batch.column("side").cast(pa.string()), "/")
            code = mark.dictionary_encode().indices.to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1, [len(code)]))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if lo == hi:
                    continue
                part, name = batch.slice(lo, hi - lo), batch.column("key")[int(lo)].as_py()
                if name != key:
                    key, shard, state = name, [], None
                if batch.column("side")[int(lo)].as_py() == 0:
                    shard.append(part)
                elif shard:
                    state = state or held(pa.Table.from_batches(shard))
                    for at in range(0, hi - lo, BLOCK_QUERIES):
                        found = score(state, pa.Table.from_batches([part.slice(at, BLOCK_QUERIES)]))
                        yield pa.RecordBatch.from_pydict(found, schema=made)

    from pyspark.sql.pandas.types import to_arrow_schema
    both = (vectors.withColumn("side", F.lit(0))
            .unionByName(queries.withColumn("side", F.lit(1)), allowMissingColumns=True))
    empty = both.sparkSession.createDataFrame([], schema)
    fields = list(to_arrow_schema(empty.schema))
    return both.repartition("key").sortWithinPartitions("key", "side").mapInArrow(rows, empty.schema)


def _numbered(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, n): vectors and their lengths; null or empty vectors and vectors with null
    or NaN components take no part."""
    v = F.col("v")
    return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)))
            .withColumn("n", F.size("v")))


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, ["query_id"], [F.col("score").desc(), F.col("doc_id").asc()], k)


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 10, query_id: str = "query_id",
                 vector_col: str = "embedding", index_id: str = "vec_id",
                 index_vector_col: str = "embedding") -> DataFrame:
    """V6: exact inner-product top-k per query (rows: query_id, rank, doc_id, score).

    A query meets the vectors of its own length only. Every vector is sent once, to its
    shard; every query once to each shard of its length."""
    q, v = _numbered(queries, query_id, vector_col), _numbered(vectors, index_id, index_vector_col)
    shards = v.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"))  # a row a length
    key = F.format_string("%d/%d", "n", "shard")
    left = (v.join(F.broadcast(shards), "n").withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int"))
            .select(key.alias("key"), "id", "v"))
    right = (q.join(F.broadcast(shards), "n").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
             .select(key.alias("key"), "id", "v"))
    return _best(_streamed(left, right, *_shard_top_k(k), "query_id long, doc_id long, score double"), k)


# --------------------------------------------------------------------- V7
#: vectors the cells are fitted on, at most, for each cell (all are indexed)
FIT_ROWS = 256
#: error of a component rounded to one of 255 steps, as a share of the largest residual
_STEP = 0.5 / 127


@dataclass
class CellIndex:
    table: DataFrame       # cell (partition), part, id, code: one byte a component, scale, v
    centers: np.ndarray    # n_cells rows: the quantiser itself


def build_cell_index(vectors: DataFrame, n_cells: int, path: str | None = None, index_id: str = "vec_id",
                     vector_col: str = "embedding", seed: int = 42) -> CellIndex:
    """V7: writes the index under ``path`` (default: a scratch table). Cells come from Spark ML
    KMeans on at most ``FIT_ROWS`` x ``n_cells`` vectors, picked by a hash; every vector is
    indexed. All vectors must have one length. Cells larger than ``SHARD_ROWS`` are split."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    spark = vectors.sparkSession
    v = _numbered(vectors, index_id, vector_col)
    fit = v.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(FIT_ROWS * n_cells).select(array_to_vector("v").alias("f"))
    model = KMeans(k=n_cells, seed=seed, featuresCol="f", predictionCol="cell").fit(fit)
    centers = np.stack(model.clusterCenters())

    def code(batches):
        for batch in batches:
            m = _matrix(pa.Table.from_batches([batch])["v"], centers.shape[1])
            cell = np.argmin((centers ** 2).sum(axis=1) - 2 * m @ centers.T, axis=1)
            rest = m - centers[cell]
            scale = np.abs(rest).max(axis=1)
            steps = np.rint(rest / np.where(scale > 0, scale, 1)[:, None] * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([s.tobytes() for s in steps], pa.binary()), pa.array(scale),
                 batch.column("v"), pa.array(cell.astype(np.int32))], ["id", "code", "scale", "v", "cell"])

    coded = v.select("id", "v").mapInArrow(code, "id long, code binary, scale double, v array<double>, cell int")
    coded = materialise(coded, "coded_vectors")
    parts = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("parts"))
    path = path or scratch_path(spark, "cell_index")
    (coded.join(F.broadcast(parts), "cell")  # a row a cell
     .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
     .repartition("cell", "part").write.mode("overwrite").partitionBy("cell", "part").parquet(f"{path}/cells"))
    (spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>")
     .write.mode("overwrite").parquet(f"{path}/centers"))
    return read_cell_index(spark, path)


def read_cell_index(spark, path: str) -> CellIndex:
    schema = "id long, code binary, scale double, v array<double>, cell int, part int"
    centers = spark.read.parquet(f"{path}/centers").orderBy("cell").collect()  # n_cells rows
    return CellIndex(spark.read.schema(schema).parquet(f"{path}/cells"), np.array([r.center for r in centers]))


def _nearest_cells(queries: DataFrame, centers: np.ndarray, n_probe: int) -> DataFrame:
    """(id, v, cell, at, place): each query at its ``n_probe`` nearest centres, with its product with the
    centre and the centre's place (from 1)."""
    def rows(batches):
        for batch in batches:
            m = _matrix(pa.Table.from_batches([batch])["v"], centers.shape[1])
            dots = m @ centers.T
            cell = np.argsort((centers ** 2).sum(axis=1) - 2 * dots, axis=1, kind="stable")[:, :n_probe]
            row = np.repeat(np.arange(len(m)), cell.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row)),
                 pa.array(cell.ravel().astype(np.int32)), pa.array(dots[row, cell.ravel()]),
                 pa.array(np.tile(np.arange(1, cell.shape[1] + 1, dtype=np.int32), len(m)))],
                ["id", "v", "cell", "at", "place"])

    return (queries.where(F.col("n") == centers.shape[1]).select("id", "v")
            .mapInArrow(rows, "id long, v array<double>, cell int, at double, place int"))


def _code_bounds(k: int):
    """Bounds of every score by the bytes alone; rows that may be among a query's k best."""
    def held(shard: pa.Table):
        code = np.frombuffer(b"".join(shard["code"].to_pylist()), np.int8).reshape(shard.num_rows, -1)
        return shard["id"].to_numpy(), code.astype(np.float32), shard["scale"].to_numpy(), shard["cell"][0].as_py()

    def score(state, block: pa.Table) -> dict:
        ids, code, scale, cell = state
        q = _matrix(block["v"], code.shape[1])
        about = block["at"].to_numpy()[:, None] + (q.astype(np.float32) @ code.T) * (scale / 127)
        # rounded bytes, single precision and the rounding of scores
        error = np.abs(q).sum(axis=1)[:, None] * scale * (_STEP + 1e-4) + 10.0 ** -SCORE_DIGITS
        at_q, at_v = np.nonzero(about + error >= _edge(about - error, k))
        return {"query_id": block["id"].to_numpy()[at_q], "doc_id": ids[at_v], "cell": np.full(len(at_q), cell, np.int32),
                "low": (about - error)[at_q, at_v], "high": (about + error)[at_q, at_v]}

    return held, score


def _in_cells_of(index: CellIndex, rows: DataFrame) -> DataFrame:
    """The index without the partitions of cells that no row of ``rows`` names; no file of
    theirs is read. The driver holds the names, at most one a centre."""
    return index.table.where(F.col("cell").isin([r.cell for r in rows.select("cell").distinct().collect()]))


def cell_candidates(queries: DataFrame, index: CellIndex, k: int, n_probe: int, query_id: str = "query_id",
                    vector_col: str = "embedding") -> DataFrame:
    """(query_id, doc_id, cell): the vectors of the probed cells that may be among a query's k best."""
    probes = _nearest_cells(_numbered(queries, query_id, vector_col), index.centers, n_probe)
    probes = materialise(probes, "cell_probes")
    sizes = index.table.select("cell", "part").distinct()
    key = F.format_string("%d/%d", "cell", "part").alias("key")
    codes = _in_cells_of(index, probes).select(key, "id", "cell", "code", "scale")
    asked = probes.join(F.broadcast(sizes), "cell").select(key, "id", "v", "at")  # a row a part of a cell
    found = _streamed(codes, asked, *_code_bounds(k), "query_id long, doc_id long, cell int, low double, high double")
    found = materialise(found, "cell_bounds")
    least = (top_k(found, ["query_id"], [F.col("low").desc(), F.col("doc_id")], k).where(F.col("rank") == k)
             .select("query_id", F.col("low").alias("least")))
    return (found.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("high") >= F.col("least")))
            .select("query_id", "doc_id", "cell"))


def cell_search(queries: DataFrame, index: CellIndex, k: int = 10, n_probe: int = 2, query_id: str = "query_id",
                vector_col: str = "embedding") -> DataFrame:
    """V7: top-k (query_id, doc_id, score, rank) among the vectors of each query's ``n_probe``
    nearest cells: bounds by the bytes, then exact scores of what survives."""
    q = _numbered(queries, query_id, vector_col).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    few = materialise(cell_candidates(queries, index, k, n_probe, query_id, vector_col), "cell_candidates")
    whole = _in_cells_of(index, few).select(F.col("id").alias("doc_id"), "cell", "v")
    scored = (few.join(whole, ["cell", "doc_id"]).join(q, "query_id")
              .select("query_id", "doc_id", F.round(F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0),
                                                                lambda s, x: s + x), SCORE_DIGITS).alias("score")))
    return _best(scored, k)


def probes_for_recall(index: CellIndex, k: int, recall: float, sample: int = 256, seed: int = 1) -> int:
    """The least ``n_probe`` whose cells hold the share ``recall`` of the exact k nearest of a
    sample of at most ``sample`` indexed vectors, picked by a hash (themselves left out)."""
    vectors = index.table.select("id", "v")
    asked = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    near = (dense_search(asked, vectors, k + 1, "id", "v", "id", "v").where("query_id <> doc_id")
            .join(index.table.select(F.col("id").alias("doc_id"), "cell"), "doc_id"))
    places = _nearest_cells(_numbered(asked, "id", "v"), index.centers, len(index.centers)).select(
        F.col("id").alias("query_id"), "cell", "place")
    held = {r.place: r["count"] for r in near.join(places, ["query_id", "cell"]).groupBy("place").count().collect()}
    total, seen = sum(held.values()), 0
    for place in sorted(held):
        seen += held[place]
        if seen >= recall * total:
            return place
    return len(index.centers)


def build_ivf(vectors: DataFrame, n_cells: int, vector_col: str = "embedding", seed: int = 42,
              index_id: str = "vec_id") -> CellIndex:
    """V7 under its earlier name: a cell index in a scratch table."""
    return build_cell_index(vectors, n_cells, None, index_id, vector_col, seed)


def ivf_search(queries: DataFrame, vectors: DataFrame, model: CellIndex, k: int = 10, n_probe: int = 2,
               query_id: str = "query_id", vector_col: str = "embedding",
               index_id: str = "vec_id") -> DataFrame:
    """V7 under its earlier name; the vectors are those the index was built from."""
    return cell_search(queries, model, k, n_probe, query_id, vector_col)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact top-k hits the approximate search also returns."""
    hit = exact.join(approx.select("query_id", "doc_id", F.lit(1).alias("_h")),
                     ["query_id", "doc_id"], "left")
    return hit.agg(F.avg(F.coalesce("_h", F.lit(0))).alias("recall_at_k"))
