"""Registered queries of readers, batching, pooling and retrieval entry points."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlane.operators import batching as BT
from searchlane.operators import datasets as DS
from searchlane.operators import rollouts as RO
from searchlane.operators.bm25 import bm25_search, build_bm25, retrieve
from searchlane.operators.dense import pool
from searchlane.operators.metrics import metrics_wide, write_metrics
from searchlane.operators.retrieval_extras import retrieve_cached
from searchlane.plans.agent_plans import _sql_trunc
from searchlane.plans.registry import SQL_BM25_HITS, SQL_CORPUS, SQL_FX, register
from searchlane.session import scratch_path
from searchlane.sources import fixtures as fx
from searchlane.sources import io
from searchlane.sources.tables import Tables


@register("prompt_splits", sql=f"""
WITH {SQL_FX['qa']}
SELECT qid AS "index", CASE WHEN qid % 5 = 0 THEN 'test' ELSE 'train' END AS split, 'nq' AS data_source,
       len(golden_answers)::BIGINT AS n_targets FROM qa""")
def q_prompt_splits(spark, sf_dir):
    """Two prompt splits written as parquet and read together under the declared schema."""
    qa = fx.qa(Tables(spark, sf_dir)).withColumnRenamed("qid", "index")
    base = scratch_path(spark, "prompts")
    for split, keep in (("train", F.col("index") % 5 != 0), ("test", F.col("index") % 5 == 0)):
        io.write_split(DS.build_prompt_rows(qa.filter(keep), "nq", split, "nq_search"), base, split)
    rows = io.read_prompts(spark, [f"{base}/train.parquet", f"{base}/test.parquet"])
    return rows.select(F.col("extra_info.index").alias("index"), F.col("extra_info.split").alias("split"), "data_source",
                       F.size("reward_model.ground_truth.target").cast("long").alias("n_targets"))


@register("qa_jsonl", sql=f"""
WITH {SQL_FX['qa']} SELECT qid, md5(question) AS question_md5, golden_answers[1] AS golden FROM qa""")
def q_qa_jsonl(spark, sf_dir):
    """QA rows written as JSON lines and read back with a declared schema."""
    qa = fx.qa(Tables(spark, sf_dir))
    path = scratch_path(spark, "qa")
    io.write_jsonl(qa, path)
    back = io.read_jsonl(spark, path, qa.schema)
    return back.select("qid", F.md5("question").alias("question_md5"), F.element_at("golden_answers", 1).alias("golden"))


@register("metric_log", sql="""
SELECT epoch(date_trunc('day', ts))::BIGINT // 86400 AS step,
       round(sum(value) FILTER (event_type = 'click'), 6) AS click, round(sum(value) FILTER (event_type = 'view'), 6) AS view
FROM events GROUP BY 1""")
def q_metric_log(spark, sf_dir):
    """Daily sums per event type logged as (step, metric, value) and read as a wide table."""
    day = F.floor(F.unix_timestamp(F.date_trunc("day", "ts")) / 86400)
    daily = (Tables(spark, sf_dir).events.groupBy(day.alias("step"), F.col("event_type").alias("metric"))
             .agg(F.sum("value").alias("value")))
    path = scratch_path(spark, "metrics")
    write_metrics(daily, path)
    wide = metrics_wide(spark.read.parquet(path), ["click", "view"])
    return wide.select("step", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))


@register("sample_at_most", sql=f"""
WITH {SQL_FX['qa']} SELECT qid, question FROM qa""")
def q_sample_at_most(spark, sf_dir):
    """P10: more rows asked for than there are: all stay."""
    qa = fx.qa(Tables(spark, sf_dir))
    return DS.sample_at_most(qa, qa.count() + 1, "qid").select("qid", "question")


@register("merged_sources", sql="""
SELECT 'part' AS data_source, 'test' AS split, p_partkey AS key FROM part WHERE p_partkey % 10 >= 8
UNION ALL SELECT 'orders', 'train', o_orderkey FROM orders""")
def q_merged_sources(spark, sf_dir):
    """Each source contributes its first available split (test, dev, train)."""
    t = Tables(spark, sf_dir)
    part = t.part.select(F.col("p_partkey").alias("key"))
    orders = t.orders.select(F.col("o_orderkey").alias("key"))
    out = DS.merge_sources({"part": {"train": part.filter("key % 10 < 8"), "test": part.filter("key % 10 >= 8")},
                            "orders": {"train": orders}})
    return out.select("data_source", "split", "key")


@register("concat_restore", sql="""
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS row_idx FROM orders""")
def q_concat_restore(spark, sf_dir):
    """W5 + W10: a table indexed, cut in two by length class, concatenated and put back in order."""
    idx = BT.with_row_index(Tables(spark, sf_dir).orders.select("o_orderkey"), ["o_orderkey"])
    both = BT.concat_batches(idx.filter("o_orderkey % 3 = 0"), idx.filter("o_orderkey % 3 <> 0"))
    return BT.restore_order(both).select("o_orderkey", "row_idx")


@register("pooled_vectors", sql="""
WITH h AS (SELECT vec_id, embedding AS e FROM embeddings),
p AS (SELECT vec_id, list_transform(range(1, 33), lambda j: (e[j]::DOUBLE + e[j + 32]::DOUBLE) / 2) AS two,
             list_transform(range(1, 33), lambda j: e[j]::DOUBLE) AS one FROM h)
SELECT vec_id, round(list_sum(two), 6) AS mean_both, round(list_sum(one), 6) AS mean_first, round(list_sum(one), 6) AS cls
FROM p""")
def q_pooled_vectors(spark, sf_dir):
    """V4: every vector read as two tokens of half its length, pooled by masked mean (both
    tokens, then the first alone) and by first token."""
    e = Tables(spark, sf_dir).embeddings
    v = F.col("embedding").cast("array<double>")
    h = e.select("vec_id", F.array(F.slice(v, 1, 32), F.slice(v, 33, 32)).alias("h"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    both, first = F.array(F.lit(1), F.lit(1)), F.array(F.lit(1), F.lit(0))
    return h.select("vec_id", total(pool("h", both)).alias("mean_both"), total(pool("h", first)).alias("mean_first"),
                    total(pool("h", first, "cls")).alias("cls"))


_SQL_BENCH_Q = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


@register("retrieve_dispatch", sql=f"""
WITH {SQL_CORPUS}, {_SQL_BENCH_Q}, {SQL_BM25_HITS.replace('{k}', '5')}
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM hits""")
def q_retrieve_dispatch(spark, sf_dir):
    """V8: the retriever named ``bm25`` through the dispatch."""
    t = Tables(spark, sf_dir)
    hits = retrieve(fx.queries(t), "bm25", 5, index=build_bm25(fx.corpus(t)))
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


@register("question_file", sql=f"""
WITH {SQL_CORPUS}, w AS (SELECT item_id AS query_id, text AS query, row_number() OVER (ORDER BY item_id) AS rn FROM benchmark),
q AS (SELECT query_id, query FROM w WHERE rn > (SELECT count(*) // 4 FROM benchmark)),
{SQL_BM25_HITS.replace('{k}', '3')}
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM hits""")
def q_question_file(spark, sf_dir):
    """A window of the question list (all but its first quarter) is cut and retrieved."""
    t = Tables(spark, sf_dir)
    qs = fx.queries(t)
    window = DS.slice_rows(qs, ["query_id"], offset=qs.count() // 4)
    hits = bm25_search(window, build_bm25(fx.corpus(t)), 3)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


@register("cached_retrieval", sql=f"""
WITH {SQL_CORPUS}, b AS (SELECT item_id, text AS query FROM benchmark),
q AS (SELECT DISTINCT query AS query_id, query FROM b),
{SQL_BM25_HITS.replace('{k}', '2')}
SELECT b.item_id, h.rank::INTEGER AS rank, h.doc_id, h.score FROM b LEFT JOIN hits h ON h.query_id = b.query""")
def q_cached_retrieval(spark, sf_dir):
    """Two steps over a cache of ten queries: half of the requests warm it, then all are
    answered, whatever the cache keeps."""
    t = Tables(spark, sf_dir)
    index = build_bm25(fx.corpus(t))

    def search(misses):
        ids = misses.withColumn("query_id", F.col("query"))
        return bm25_search(ids, index, 2).select(F.col("query_id").alias("query"), "rank", "doc_id", "score")

    asked = t.benchmark.select("item_id", F.col("text").alias("query"))
    _, cache = retrieve_cached(asked.filter("item_id % 2 = 0"), None, search, step=1, capacity=10)
    results, _ = retrieve_cached(asked, cache, search, step=2, capacity=10)
    return results.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


@register("capped_observations", sql=f"""
SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN text ELSE {_sql_trunc('text', 8)} END) AS capped_md5
FROM conversations""")
def q_capped_observations(spark, sf_dir):
    """A5: observations with a budget of eight tokens are cut, those without stay whole."""
    c = Tables(spark, sf_dir).conversations.withColumn("budget", F.when(F.col("turn") % 2 == 1, F.lit(8)))
    return c.select("conv_id", "turn", F.md5(RO.cap_observation("text", "budget")).alias("capped_md5"))
