"""Sparse retrieval: BM25 index build (V1) and batch top-k search (V2).

Layout: a *document-partitioned* index. Texts are tokenised by Spark and counted in Arrow
where they lie; only the counts are dealt to shards by a hash of ``doc_id``. A shard is cut
into blocks of at most ``BLOCK_DOCS`` documents of similar length, and a posting row holds
all documents of one block that use one term, with the block's largest frequency and
smallest length of the term, so that a bound of any score in the block is read without its
postings. Rows are bucketed by shard: a search needs no exchange before its partial top-k.

A search takes the queries in rounds of bounded weights, broadcast one round at a time: a
round meets the posting rows by term, and each document block is one task-local matrix
product with the round's queries, taken a bounded number of cells at a time, so no (query,
document) pair is ever a row; at most k rows a query leave a block. Postings are read once
a round and never copied for a block of queries.
Where the index has many blocks, blocks that cannot reach a query's k-th score are
skipped: each query is first scored in the blocks of its largest bounds, and its k-th score
there is the least any other block has to be able to reach (``prune``).

Scoring (our documented parameters; the reference relies on library defaults):
    idf(t)    = ln(1 + (N - df + 0.5) / (df + 0.5))
    score(q,d)= sum_t qtf(t) * idf(t) * tf*(k1+1) / (tf + k1*(1 - b + b*dl/avgdl))
with k1 = 0.9, b = 0.4; ties broken by doc_id ascending; scores rounded to
1e-6 before ranking so every engine ranks identically.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlane.functions.text import analyzer_terms
from searchlane.operators.common import spread, top_k
from searchlane.session import materialise, register_scratch_table, scratch_path

K1 = 0.9
B = 0.4
SCORE_DIGITS = 6
#: documents of one block of postings
BLOCK_DOCS = 4096
#: cells of 8 bytes of one product, and queries of it at most
CELLS = 2 << 20
QUERY_BLOCK = 4096
#: (term, query) weights of one round of queries, which is broadcast
ROUND_WEIGHTS = 1_000_000
#: characters of the texts that go to one part of the index: what a task holds doesn't grow with the corpus
PART_CHARS = 4 << 20
#: words of a batch that are counted at once
COUNT_WORDS = 1 << 18
#: blocks of the index from which a search skips blocks by their bounds
PRUNE_FROM = 4096
#: (block, query) bounds above which it doesn't: their table would outgrow the postings
PRUNE_BOUNDS = 20_000_000
#: blocks a query is scored in before the others are held against its k-th score
SEEDS = 2
#: cells, and share of the cells, from which a posting row is a row of a dense product; rows of
#: one dense product, and updates by the other rows that are made at once
OUTER = 512
DENSE = 0.003
DENSE_ROWS = 256
UPDATES = 1 << 18


@dataclass
class BM25Index:
    postings: DataFrame    # shard, block, term (null: all documents), docs, tfs, lens, tf_max, len_min
    term_df: DataFrame     # term, df
    n_docs: int
    avgdl: float
    n_blocks: int
    k1: float = K1
    b: float = B


def _runs(codes: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, with the length at the end."""
    return np.concatenate((np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))), [len(codes)])) \
        if len(codes) else np.zeros(1, np.int64)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _term_counts(batches):
    """Per document: length, distinct terms (joined by a space, which no term has) and their
    frequencies, for about ``COUNT_WORDS`` words at once."""
    for batch in batches:
        tokens = batch.column("_terms")
        lengths = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, lo = np.cumsum(lengths), 0
        while lo < len(lengths):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + COUNT_WORDS, "right")))
            coded = tokens.slice(lo, hi - lo).flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            width = max(1, len(coded.dictionary))
            pair = np.sort(np.repeat(np.arange(hi - lo), lengths[lo:hi]) * width + code)
            starts = _runs(pair)
            first = pair[starts[:-1]]
            offsets = np.searchsorted(first // width, np.arange(hi - lo + 1))
            terms = pc.binary_join(_lists(offsets, coded.dictionary.take(pa.array(first % width))), " ")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.array(lengths[lo:hi]), terms,
                 _lists(offsets, pa.array(np.diff(starts).astype(np.int32)))], ["doc_id", "doc_len", "terms", "tfs"])
            lo = hi


def _inverted(block_docs: int, schema: pa.Schema):
    """Documents sorted by (shard, length) to posting rows of blocks of ``block_docs`` documents."""
    def invert(shard: int, number: int, part: pa.Table) -> pa.RecordBatch:
        tfs = part["tfs"].combine_chunks()
        lens = part["doc_len"].to_numpy().astype(np.int32)
        at = np.repeat(np.arange(len(lens)), pc.list_value_length(tfs).to_numpy(zero_copy_only=False))
        # a document without terms has an empty string, not one empty term
        terms = pc.split_pattern(part["terms"].combine_chunks().filter(pa.array(lens > 0)), " ")
        coded, tf = terms.flatten().dictionary_encode(), tfs.flatten().to_numpy(zero_copy_only=False)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(code, kind="stable")
        starts, at, tf = _runs(code[order]), at[order], tf[order]
        n = len(starts)  # the rows of the terms, and one of all documents
        every = np.concatenate((at, np.arange(len(lens))))
        offsets = np.concatenate((starts, [len(every)]))
        tf = np.concatenate((tf, np.zeros(len(lens), np.int32)))
        cut = offsets[:-1] if len(every) else np.empty(0, np.int64)
        names = coded.dictionary.take(pa.array(code[order][starts[:-1]]))
        return pa.RecordBatch.from_arrays(
            [pa.array([shard] * n, pa.int32()), pa.array([number] * n, pa.int32()),
             pa.concat_arrays([names, pa.nulls(1, names.type)]),
             _lists(offsets, part["doc_id"].combine_chunks().take(pa.array(every))), _lists(offsets, pa.array(tf)),
             _lists(offsets, pa.array(lens[every])), pa.array(np.maximum.reduceat(tf, cut)),
             pa.array(np.minimum.reduceat(lens[every], cut))],
            ["shard", "block", "term", "docs", "tfs", "lens", "tf_max", "len_min"]).cast(schema)

    def rows(batches):
        held, shard, number, size = [], None, 0, 0
        for batch in batches:
            ids = batch.column("shard").to_numpy(zero_copy_only=False)
            for lo, hi in zip((at := _runs(ids))[:-1], at[1:]):
                if ids[lo] != shard:
                    if size:
                        yield invert(shard, number, pa.Table.from_batches(held))
                    held, shard, number, size = [], int(ids[lo]), 0, 0
                while lo < hi:
                    take = min(hi - lo, block_docs - size)
                    held.append(batch.slice(lo, take))
                    lo, size = lo + take, size + take
                    if size == block_docs:
                        yield invert(shard, number, pa.Table.from_batches(held))
                        held, number, size = [], number + 1, 0
        if size:
            yield invert(shard, number, pa.Table.from_batches(held))

    return rows


def build_bm25(corpus: DataFrame, id_col: str = "id", text_col: str = "contents",
               num_shards: int | None = None, materialize: bool = True, block_docs: int = BLOCK_DOCS) -> BM25Index:
    """V1: terms and frequencies are counted where the texts lie, and only they are dealt
    by ``doc_id``. Postings are written once as a table bucketed by shard in the
    shared ``spark.checkpoint.dir``; document frequencies, the number of documents and
    their mean length are stored with it. Without ``materialize`` the postings stay a plan
    that each use computes. A null or empty text is a document without terms; ids must be
    unique and not null."""
    spark = corpus.sparkSession
    # buckets: explicit, else configured, else one per PART_CHARS characters of text and per
    # input split of the corpus, two per core at least
    n = num_shards or int(spark.conf.get("searchlane.bm25.shards", "0"))
    if not n:
        chars = corpus.agg(F.sum(F.length(text_col))).first()[0] or 0
        n = max(corpus.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism, -(-chars // PART_CHARS))
        n = min(n, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    docs = spread(corpus).select(F.col(id_col).alias("doc_id"),
                         F.coalesce(analyzer_terms(text_col), F.array().cast("array<string>")).alias("_terms"))
    doc_id = docs.schema["doc_id"]
    longs = T.ArrayType(T.IntegerType())
    counted = docs.mapInArrow(_term_counts, T.StructType([
        doc_id, T.StructField("doc_len", T.LongType()), T.StructField("terms", T.StringType()), T.StructField("tfs", longs)]))
    dealt = (counted.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(4 * n)).cast("int"))
             .repartition(n, "shard").sortWithinPartitions("shard", "doc_len"))
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()),
                           T.StructField("term", T.StringType()), T.StructField("docs", T.ArrayType(doc_id.dataType)),
                           T.StructField("tfs", longs), T.StructField("lens", longs),
                           T.StructField("tf_max", T.IntegerType()), T.StructField("len_min", T.IntegerType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    postings = dealt.mapInArrow(_inverted(block_docs, to_arrow_schema(schema)), schema)
    return index_of(_write_bucketed(postings, n) if materialize else postings)


def index_of(postings: DataFrame, term_df: DataFrame | None = None) -> BM25Index:
    """Index over a postings table; statistics that aren't given are computed and stored."""
    if term_df is None:
        term_df = materialise(postings.where(F.col("term").isNotNull()).groupBy("term")
                              .agg(F.sum(F.size("docs")).alias("df")), "bm25_terms")
    long_sum = F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x)
    stats = (postings.where(F.col("term").isNull())
             .agg(F.sum(F.size("docs")).alias("n"), F.sum(long_sum).alias("len"), F.count(F.lit(1)).alias("blocks")).first())
    n = stats["n"] or 0
    return BM25Index(postings=postings, term_df=term_df, n_docs=n, avgdl=(stats["len"] or 0) / n if n and stats["len"] else 1.0,
                     n_blocks=stats["blocks"])


def _write_bucketed(postings: DataFrame, n: int) -> DataFrame:
    """Write postings once as a table bucketed by ``shard`` in the shared checkpoint folder.
    Unlike a checkpointed RDD, a bucketed scan reports ``HashPartitioning(shard)``, so
    searches group by block inside each shard without an exchange. Survives executor
    loss (files, not cache)."""
    spark = postings.sparkSession
    name = f"bm25_postings_{uuid.uuid4().hex[:12]}"
    path = scratch_path(spark, name)
    (postings.write.mode("overwrite").option("path", path).option("compression", "zstd")
     .bucketBy(n, "shard").saveAsTable(name))
    register_scratch_table(name, path)   # removed by session.release_scratch()
    return spark.table(name)


def write_bm25(index: BM25Index, path: str) -> None:
    """Persist the index: postings sorted by term inside each file, and its terms."""
    index.postings.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.term_df.write.mode("overwrite").parquet(f"{path}/terms")


def read_bm25(spark, path: str) -> BM25Index:
    return index_of(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"))


def query_terms(queries: DataFrame, query_id: str = "query_id", query_col: str = "query") -> DataFrame:
    """Distinct analysed terms per query with their in-query frequency."""
    return (queries.select(F.col(query_id).alias("query_id"),
                           F.explode(analyzer_terms(query_col)).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def _products(k: int, k1: float, b: float, avgdl: float, query_block: int):
    """Scores of one block of documents for the queries of a round; the k best of each query."""
    def score(table: pa.Table) -> pa.Table:
        def coded(name):
            """Sorted distinct values of a list column, each entry's place among them, offsets."""
            column = table[name].combine_chunks()
            flat, offsets = column.flatten(), column.offsets.to_numpy().astype(np.int64)
            known = pc.unique(flat)
            known = known.take(pc.sort_indices(known))
            return known, pc.index_in(flat, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0]

        docs, d, d_at = coded("docs")
        queries, q, q_at = coded("qs")
        flat = lambda name: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        tf, w = flat("tfs"), flat("ws")
        gain = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * flat("lens") / avgdl))
        # the queries of a row in their order, so that a row's share of some queries is a range
        of_row = np.repeat(np.arange(len(q_at) - 1), np.diff(q_at)) * len(queries) + q
        order = np.argsort(of_row, kind="stable")
        of_row, q, w = of_row[order], q[order], w[order]
        n_docs, many_d = len(docs), np.diff(d_at)
        at = np.repeat(np.arange(len(many_d)), many_d)
        place = np.sort(at * n_docs + d)
        if (place[1:] == place[:-1]).any():  # an id that comes twice: in a row of many products its last entry counts
            place = at * n_docs + d
            last = np.argsort(place, kind="stable")
            keep = np.zeros(len(d), bool)
            keep[last[np.concatenate((place[last][1:] != place[last][:-1], [True]))]] = True
            keep |= (many_d * np.diff(q_at) < OUTER)[at]
            d, gain, many_d = d[keep], gain[keep], np.bincount(at[keep], minlength=len(many_d))
            d_at = np.concatenate(([0], np.cumsum(many_d)))
        rows = np.arange(len(many_d)) * len(queries)
        step, found = max(1, min(query_block, CELLS // max(n_docs, 1))), []
        for lo in range(0, len(queries), step):
            width = min(step, len(queries) - lo)
            begin, end = np.searchsorted(of_row, rows + lo), np.searchsorted(of_row, rows + lo + width)
            count = many_d * (end - begin)
            cells = np.zeros((width, n_docs))
            large = count >= max(OUTER, DENSE * cells.size)
            some = np.flatnonzero(large)
            for at in range(0, len(some), DENSE_ROWS):  # terms that many documents and queries have
                part = some[at:at + DENSE_ROWS]
                of_q, of_d = np.zeros((len(part), width)), np.zeros((len(part), n_docs))
                for i, r in enumerate(part):
                    of_q[i, q[begin[r]:end[r]] - lo] = w[begin[r]:end[r]]
                    of_d[i, d[d_at[r]:d_at[r + 1]]] = gain[d_at[r]:d_at[r + 1]]
                cells += of_q.T @ of_d
            some = np.flatnonzero(~large & (count > 0))
            ends, at = np.cumsum(count[some]), 0
            while at < len(some):  # the other products, a bounded number of updates at once
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + UPDATES, "right")))
                part = some[at:to]
                row = np.repeat(part, count[part])
                within = np.arange(len(row)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
                in_d, in_q = d_at[row] + within % many_d[row], begin[row] + within // many_d[row]
                np.add.at(cells.reshape(-1), (q[in_q] - lo) * n_docs + d[in_d], w[in_q] * gain[in_d])
                at = to
            least = 0.0
            if n_docs > k:  # rounding may bring scores this much together
                least = np.maximum(np.partition(cells, n_docs - k, axis=1)[:, n_docs - k, None] - 2 * 10.0 ** -SCORE_DIGITS, 0)
            row, col = np.nonzero((cells > 0) & (cells >= least))
            got = np.round(cells[row, col], SCORE_DIGITS)
            order = np.lexsort((col, -got, row))  # ties by doc_id: columns are in its order
            row, col, got = row[order], col[order], got[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((row[best] + lo, col[best], got[best]))
        row, col, got = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table({"query_id": queries.take(pa.array(row)), "doc_id": docs.take(pa.array(col)), "score": pa.array(got)})
    return score


def _scored(index: BM25Index, weights: DataFrame, k: int, blocks: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): the k best of each block for each query of ``weights`` (term,
    query_id, query_block, w; one round, which is broadcast); with ``blocks`` (shard, block, query_id)
    only there, for any number of rounds."""
    matches = index.postings.where(F.col("term").isNotNull()).select("shard", "block", "term", "docs", "tfs", "lens")
    if blocks is None:
        by, keys = ["shard", "block"], ["term"]
        asked = F.broadcast
    else:  # the queries left differ from block to block
        by, keys = ["shard", "block", "query_block"], ["shard", "block", "query_block", "term"]
        asked, weights = (lambda x: x), blocks.join(weights, "query_id")
    lists = weights.groupBy(*keys).agg(F.collect_list(F.struct("query_id", "w")).alias("x")).select(
        *keys, F.col("x.query_id").alias("qs"), F.col("x.w").alias("ws"))
    matches = matches.join(asked(lists), [c for c in keys if c != "query_block"])
    kinds = {f.name: f.dataType for f in weights.schema} | {"doc_id": index.postings.schema["docs"].dataType.elementType}
    out = T.StructType([T.StructField("query_id", kinds["query_id"]), T.StructField("doc_id", kinds["doc_id"]),
                        T.StructField("score", T.DoubleType())])
    return matches.groupBy(*by).applyInArrow(_products(k, index.k1, index.b, index.avgdl, QUERY_BLOCK), out)


def block_bounds(index: BM25Index, weights: DataFrame) -> DataFrame:
    """(shard, block, query_id, bound): no document of the block scores above ``bound``."""
    tf, norm = F.col("tf_max"), index.k1 * (1.0 - index.b + index.b * F.col("len_min") / F.lit(index.avgdl))
    return (index.postings.where(F.col("term").isNotNull()).select("shard", "block", "term", "tf_max", "len_min")
            .join(weights, "term").groupBy("shard", "block", "query_id")
            .agg(F.sum(F.col("w") * tf * (index.k1 + 1.0) / (tf + norm)).alias("bound")))


def _best(scored: DataFrame, k: int) -> DataFrame:
    return top_k(scored, ["query_id"], [F.col("score").desc(), F.col("doc_id").asc()], k)


def surviving_blocks(index: BM25Index, weights: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The hits in each query's ``SEEDS`` blocks of largest bounds, and the other blocks
    (shard, block, query_id) whose bound reaches the query's k-th score there."""
    bounds = materialise(block_bounds(index, weights), "bm25_bounds")
    ranked = top_k(bounds, ["query_id"], [F.col("bound").desc(), F.col("shard"), F.col("block")], SEEDS, "place")
    seeds = materialise(ranked.select("shard", "block", "query_id"), "bm25_seeds")
    hits = materialise(_best(_scored(index, weights, k, seeds), k), "bm25_seed_hits")
    least = hits.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    slack = 10.0 ** -SCORE_DIGITS  # scores are rounded, and sums differ in their last digits
    left = (bounds.join(seeds, ["shard", "block", "query_id"], "left_anti").join(least, "query_id", "left")
            .where(F.col("least").isNull() | (F.col("bound") + slack >= F.col("least"))))
    return hits, materialise(left.select("shard", "block", "query_id"), "bm25_blocks")


def bm25_search(queries: DataFrame, index: BM25Index, k: int = 3, query_id: str = "query_id",
                query_col: str = "query", prune: bool | None = None) -> DataFrame:
    """V2: top-k (query_id, doc_id, score, rank); queries with fewer than k
    matching documents return fewer rows, queries with none return no rows. ``prune``
    skips blocks by their bounds (default: for an index of ``PRUNE_FROM`` blocks or more);
    the result is the same."""
    qt = query_terms(queries, query_id, query_col)
    idf: Column = F.log(F.lit(1.0) + (F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # per (query, term) weight qtf * idf, written once: its rows are counted for the bound
    # of the broadcast and for the query blocks
    weights = materialise(qt.join(index.term_df, "term").select("term", "query_id", (F.col("qtf") * idf).alias("w")),
                          "bm25_query_terms")
    rows, n_queries = weights.agg(F.count(F.lit(1)), F.approx_count_distinct("query_id")).first()
    rounds = 1 + rows // ROUND_WEIGHTS
    weights = weights.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(rounds)).cast("int"))
    if prune is None:
        prune = index.n_blocks >= PRUNE_FROM and index.n_blocks * n_queries <= PRUNE_BOUNDS
    if prune:
        hits, blocks = surviving_blocks(index, weights, k)
        return _best(hits.drop("rank").unionByName(_scored(index, weights, k, blocks)), k)
    found = [_best(_scored(index, weights.where(F.col("query_block") == r), k), k) for r in range(rounds)]
    if rounds > 1:  # written round by round: one round's weights are broadcast at a time
        found = [materialise(hits, "bm25_hits") for hits in found]
    return reduce(DataFrame.unionByName, found)


def retrieve(queries: DataFrame, method: str, k: int = 3, *, index: BM25Index | None = None,
             dense_index=None, encoder=None, query_id: str = "query_id",
             query_col: str = "query") -> DataFrame:
    """V8: retriever dispatch by method name (``bm25`` or a dense encoder name)."""
    if method == "bm25":
        return bm25_search(queries, index, k, query_id, query_col)
    from searchlane.operators.dense import dense_search, encode_texts
    qv = encode_texts(queries, encoder, id_col=query_id, text_col=query_col, is_query=True,
                      model_name=method)
    return dense_search(qv, dense_index, k, query_id="id", vector_col="embedding",
                        index_id="doc_id").withColumnRenamed("id", "query_id")
