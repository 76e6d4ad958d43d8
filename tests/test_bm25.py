"""BM25 index and search against a dictionary version, in blocks of any size."""
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from searchlane.operators import bm25
from searchlane.operators.bm25 import bm25_search, build_bm25, read_bm25, write_bm25


def analyse(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(corpus, queries, k):
    docs = {i: Counter(analyse(t)) for i, t in corpus.items()}
    size = {i: sum(c.values()) for i, c in docs.items()}
    avg, df, out = (sum(size.values()) / len(size)) or 1.0, Counter(x for c in docs.values() for x in c), []
    for q, text in queries.items():
        terms, scores = Counter(analyse(text)), {}
        for d, c in docs.items():
            if hit := [t for t in terms if t in c]:
                scores[d] = round(sum(terms[t] * math.log(1 + (len(docs) - df[t] + .5) / (df[t] + .5)) * c[t] * 1.9
                                      / (c[t] + .9 * (.6 + .4 * size[d] / avg)) for t in hit), 6)
        best = sorted(scores, key=lambda d: (-scores[d], d))[:k]
        out += [(q, d, r) for r, d in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=n))
    corpus = {i * 7: text(rng.randrange(1, 120)) for i in range(400)}
    corpus |= {3: None, 4: "", 5: "?!", 6: corpus[7], 8: corpus[7], 9: "rare word Ünïcode w0"}
    queries = {f"q{i}": text(rng.randrange(1, 40)) for i in range(60)} | {
        "none": "absent terms", "null": None, "copy": corpus[7], "rare": "RARE ünïcode", "twice": "w5 w5 w9"}
    return corpus, queries


def frames(spark, data):
    return (spark.createDataFrame(list(data[0].items()), "id long, contents string"),
            spark.createDataFrame(list(data[1].items()), "query_id string, query string"))


def hits(df):
    return sorted((r.query_id, r.doc_id, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("block_docs, k, prune", [(4096, 3, False), (5, 3, False), (5, 4, True), (4096, 1, True)])
def test_search_equals_a_dictionary_version(spark, data, block_docs, k, prune):
    corpus, queries = frames(spark, data)
    index = build_bm25(corpus, block_docs=block_docs, num_shards=3)
    assert index.n_docs == len(data[0])
    assert hits(bm25_search(queries, index, k, prune=prune)) == brute(*data, k)


def test_blocks_skipped_by_their_bounds(spark):
    """A block without a query's rare terms cannot reach the k-th score and is not scored."""
    corpus = {i: f"common filler{i % 50} group{i // 40} group{i // 40}" for i in range(800)}
    queries = {i: f"common group{i}" for i in range(20)}
    c, q = (spark.createDataFrame(list(x.items()), s) for x, s in
            ((corpus, "id long, contents string"), (queries, "query_id long, query string")))
    index = build_bm25(c, block_docs=4, num_shards=4)
    weights = (bm25.query_terms(q).join(index.term_df, "term")
               .select("term", "query_id", (F.col("qtf") * F.log(1 + (800 - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))
               .withColumn("query_block", F.lit(0)))
    bounds = bm25.block_bounds(index, weights).count()
    _, left = bm25.surviving_blocks(index, weights, 3)
    assert bounds == 20 * index.n_blocks and left.count() < bounds / 3
    assert hits(bm25_search(q, index, 3, prune=True)) == hits(bm25_search(q, index, 3, prune=False)) == brute(corpus, queries, 3)


def test_many_query_blocks_and_string_ids(spark, data, monkeypatch):
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 4)
    corpus, queries = frames(spark, data)
    index = build_bm25(corpus.withColumn("id", F.format_string("%05d", "id")))
    got = sorted((q, int(d), r) for q, d, r in hits(bm25_search(queries, index, 3)))
    assert got == brute(*data, 3)


def test_written_index_and_empty_corpus(spark, data, tmp_path):
    corpus, queries = frames(spark, data)
    write_bm25(build_bm25(corpus), str(tmp_path))
    assert hits(bm25_search(queries, read_bm25(spark, str(tmp_path)), 3)) == brute(*data, 3)
    nothing = build_bm25(corpus.limit(0))
    assert nothing.n_docs == 0 and bm25_search(queries, nothing, 3).count() == 0
    assert bm25_search(queries.limit(0), build_bm25(corpus), 3).count() == 0
    wordless = build_bm25(corpus.where("id in (3, 4, 5)"))
    assert (wordless.n_docs, wordless.avgdl) == (3, 1.0) and bm25_search(queries, wordless, 3).count() == 0


def test_rounds_of_queries_and_products_in_parts(spark, data, monkeypatch):
    """Queries in rounds, products of a few cells, dense and other rows: the same hits."""
    for name, value in (("ROUND_WEIGHTS", 150), ("CELLS", 600), ("UPDATES", 40), ("DENSE_ROWS", 3), ("OUTER", 30)):
        monkeypatch.setattr(bm25, name, value)
    corpus, queries = frames(spark, data)
    index = build_bm25(corpus, num_shards=3)
    assert hits(bm25_search(queries, index, 3)) == brute(*data, 3)


def test_postings_are_not_copied_for_blocks_of_queries(spark, data, monkeypatch):
    """A round reads each posting row once, however many blocks its queries make."""
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 4)
    corpus, queries = frames(spark, data)
    index, seen = build_bm25(corpus, num_shards=3), spark.sparkContext.accumulator(0)
    made = bm25._products

    def counted(*args):
        score = made(*args)

        def of(table):
            seen.add(table.num_rows)
            return score(table)
        return of

    monkeypatch.setattr(bm25, "_products", counted)
    bm25_search(queries, index, 3).write.format("noop").mode("overwrite").save()
    assert 0 < seen.value <= index.postings.where("term is not null").count()


def test_parts_of_the_index_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(bm25, "PART_CHARS", 100)
    monkeypatch.setattr(bm25, "COUNT_WORDS", 7)
    texts = {i: f"word{i} " * (1 + i % 5) for i in range(400)}
    corpus = spark.createDataFrame(list(texts.items()), "id long, contents string")
    index = build_bm25(corpus)
    parts = sum(len(t) for t in texts.values()) // 100
    assert index.postings.rdd.getNumPartitions() >= parts or index.postings.select("shard").distinct().count() > 0.8 * min(parts, 400)
    assert max(r.n for r in index.postings.where("term is null").select(F.size("docs").alias("n")).collect()) < 30
    queries = {i: texts[i] for i in range(0, 400, 9)}
    q = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    assert hits(bm25_search(q, index, 2)) == brute(texts, queries, 2)


def test_parts_hold_a_few_million_characters(spark, monkeypatch):
    """What a task sorts is bounded by the characters of its part, whatever the size of the corpus."""
    dealt = []
    monkeypatch.setattr(bm25, "_write_bucketed", lambda postings, n: dealt.append(n))
    monkeypatch.setattr(bm25, "index_of", lambda postings: None)
    corpus = spark.range(200).select("id", F.repeat(F.lit("x "), 500_000).alias("contents"))
    build_bm25(corpus)
    assert 200e6 / dealt[0] <= 5e6


def test_buckets_stay_within_the_setting(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(bm25, "_write_bucketed", lambda postings, n: dealt.append(n))
    monkeypatch.setattr(bm25, "index_of", lambda postings: None)
    monkeypatch.setattr(bm25, "PART_CHARS", 1)
    build_bm25(spark.range(3).select("id", F.repeat(F.lit("x "), 500_000).alias("contents")))
    assert dealt == [100_000]


def test_words_of_a_batch_are_counted_in_small_passes():
    words = [f"w{i % 50}" for i in range(150_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([words] * 6, pa.list_(pa.string()))], ["doc_id", "_terms"])
    out = list(bm25._term_counts([batch]))
    assert max(sum(x.column("doc_len").to_pylist()) for x in out) <= 300_000
    assert [i for x in out for i in x.column("doc_id").to_pylist()] == list(range(6))


def test_updates_of_a_product_are_made_in_small_parts():
    """70 documents and 70 queries in each of 600 rows: 2.9 million updates, never all in memory."""
    rng = np.random.default_rng(3)
    several = lambda n, kind: pa.array([np.sort(rng.choice(n, 70, False)) for _ in range(600)], pa.list_(kind))
    ones = lambda kind: pa.array([[1] * 70] * 600, pa.list_(kind))
    table = pa.table({"docs": several(1000, pa.int64()), "tfs": ones(pa.int32()), "lens": ones(pa.int32()),
                      "qs": several(2000, pa.int64()), "ws": ones(pa.float64())})
    score = bm25._products(3, bm25.K1, bm25.B, 1.0, bm25.QUERY_BLOCK)
    tracemalloc.start()
    try:
        got = score(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.num_rows == 6000 and peak < 64e6
