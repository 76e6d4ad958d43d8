import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchlane.operators import datasets as DS
from searchlane.operators import rollouts as RO
from searchlane.operators.dense import pool
from searchlane.operators.retrieval_extras import normalize_cse, retrieve_cached
from searchlane.streaming import jobs


def test_pooling_methods(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [100.0, 100.0]], [1, 1, 0])],
                               "h array<array<double>>, m array<int>")
    r = df.select(pool("h", "m", "mean").alias("mean"), pool("h", "m", "cls").alias("cls")).first()
    assert r["mean"] == [2.0, 3.0] and r["cls"] == [1.0, 2.0]
    with pytest.raises(NotImplementedError):
        pool("h", "m", "max")


def test_retrieve_cached_lru(spark):
    calls = []

    def fake_retrieve(q):
        calls.append(sorted(r["query"] for r in q.collect()))
        return q.select("query", F.lit(1).alias("rank"), F.length("query").cast("long").alias("doc_id"))

    r1 = spark.createDataFrame([("a",), ("bb",), ("a",)], "query string")
    res1, cache = retrieve_cached(r1, None, fake_retrieve, step=1, capacity=2)
    assert res1.count() == 3
    cache = cache.cache()
    r2 = spark.createDataFrame([("ccc",), ("a",)], "query string")
    res2, cache2 = retrieve_cached(r2, cache, fake_retrieve, step=2, capacity=2)
    assert sorted(r["query"] for r in cache2.collect()) == ["a", "ccc"]   # 'bb' evicted (least recent)
    assert {r["query"]: r["doc_id"] for r in res2.collect()} == {"ccc": 3, "a": 1}
    assert calls[-1] == ["ccc"]  # only the miss was retrieved


def test_normalize_cse_defaults_and_limit(spark):
    items = spark.createDataFrame([
        (1, 0, None, "one two three four five six ... tiny"), (1, 1, "", "short"), (1, 2, "T", None),
        (1, 3, "U", "a b c d e f g"), (2, 0, "", "")], "query_id int, pos int, title string, snippet string")
    out = {(r["query_id"], r["pos"]): r["contents"] for r in normalize_cse(items, 2).collect()}
    assert out == {(1, 0): '"No title."\none two three four five six', (1, 2): '"T"\nNo snippet available.'}


def test_merge_sources_split_fallback(spark):
    a = spark.createDataFrame([(1,)], "x int")
    merged = DS.merge_sources({"nq": {"train": a, "test": a.withColumn("x", F.lit(2))},
                               "popqa": {"dev": a.withColumn("x", F.lit(3)), "train": a}})
    got = sorted((r["data_source"], r["split"], r["x"]) for r in merged.collect())
    assert got == [("nq", "test", 2), ("popqa", "dev", 3)]


def test_cap_observation_and_sample_ids(spark):
    df = spark.createDataFrame([("a b c d", None), ("a b c d", 2)], "o string, b int")
    assert [r[0] for r in df.select(RO.cap_observation("o", "b")).collect()] == ["a b c d", "a b"]
    ids = spark.createDataFrame([("train", 5, 0, "nq"), ("test", None, 7, "popqa")],
                                "split string, idx long, pos long, src string")
    assert [r[0] for r in ids.select(RO.sample_id("split", "idx", "pos")).collect()] == ["train-5", "test-7"]
    assert ids.select(RO.sample_id("split", "idx", "pos", "src", compat=False)).first()[0] == "train-nq-5"


def test_tokenizer_hooks(spark):
    df = spark.createDataFrame([([("user", "hi there"), ("assistant", "ok")],)],
                               "m array<struct<role:string,content:string>>")
    txt = df.select(RO.render_messages("m").alias("t")).first()["t"]
    assert txt == "user: hi there\nassistant: ok"
    n = df.select(RO.token_counts(RO.render_messages("m")).alias("n")).first()["n"]
    assert n == 5


def test_stream_dedupe_and_cached_retrieval(spark):
    d = tempfile.mkdtemp(prefix="sl-x2-")
    rows = spark.createDataFrame([("k1", "2024-01-01 00:00:00"), ("k1", "2024-01-01 00:05:00"),
                                  ("k2", "2024-01-01 00:06:00"), (None, "2024-01-01 00:06:00"),
                                  (None, "2024-01-01 00:06:00")], "sample_key string, ts string") \
        .withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{d}/in")
    s = spark.readStream.schema(rows.schema).parquet(f"{d}/in")
    q = jobs.start(jobs.dedupe_by_key(s), jobs.resume_sink(f"{d}/done"), checkpoint=f"{d}/ck")
    q.awaitTermination()
    keys = sorted(str(r["sample_key"]) for r in spark.read.parquet(f"{d}/done").collect())
    assert keys == ["None", "None", "k1", "k2"]  # rows without a key all stay
    sink = jobs.resume_sink(f"{d}/done")
    for batch_id in (7, 7):  # a replayed batch overwrites itself
        sink(rows.limit(1).union(rows.limit(1).withColumn("sample_key", F.lit("k9"))), batch_id)
    keys = sorted(str(r["sample_key"]) for r in spark.read.parquet(f"{d}/done").collect())
    assert keys == ["None", "None", "k1", "k2", "k9"]

    retr = lambda m: m.select("query", F.lit(9).cast("long").alias("doc_id"))
    serve = jobs.cached_retrieval_sink(retr, f"{d}/cache", f"{d}/answers")
    for batch_id, texts in ((0, ["a", "b", "b"]), (1, ["b", "c"]), (1, ["b", "c"])):
        serve(spark.createDataFrame([(t,) for t in texts], "query string"), batch_id)
    cache = sorted((r["batch_id"], r["query"]) for r in spark.read.parquet(f"{d}/cache").collect())
    assert cache == [(0, "a"), (0, "b"), (1, "c")]
    answers = sorted((r["batch_id"], r["query"], r["doc_id"]) for r in spark.read.parquet(f"{d}/answers").collect())
    assert answers == [(0, "a", 9), (0, "b", 9), (0, "b", 9), (1, "b", 9), (1, "c", 9)]


def test_cached_retrieval_answers_before_it_evicts(spark):
    from searchlane.operators.retrieval_extras import retrieve_cached
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "query string")
    retr = lambda m: m.select("query", F.lit(1).alias("rank"), F.lit(9).alias("doc_id"), F.lit(0.5).alias("score"))
    results, cache = retrieve_cached(req, None, retr, step=1, capacity=2)
    assert results.filter("doc_id IS NULL").count() == 0 and cache.select("query").distinct().count() == 2


def test_single_golden_long_numbers_and_maths_forms(spark):
    from searchlane.operators import rewards as R
    one = spark.createDataFrame([("<answer>x</answer><answer>Paris</answer>", "paris")], "full_sequence string, golden_answers string")
    assert R.score_em(one).first()["score"] == 1.0 and R.score_subem(one).first()["score"] == 1.0
    big = spark.createDataFrame([("Assistant: <answer>12345678901234567890 + 1</answer>", 2.0, [1, 1])],
                                "s string, t double, n array<int>")
    assert R.score_countdown(big, "s", "t", "n").first()["score"] == 0.1
    forms = [("\\boxed{50%}", "50", 0.0), ("\\boxed{50\\%}", "50", 1.0), ("$\\boxed 5$ so", "5", 1.0),
             ("\\boxed{\\sqrt3}", "\\sqrt{3}", 1.0), ("\\boxed{\\frac1{72}}", "\\frac{1}{72}", 1.0),
             ("\\boxed{{a}{b{c}}} x}", "{a}{b{c}}", 1.0), ("\\boxed{.5}", "\\frac{1}{2}", 1.0), ("\\boxed{x/y}", "x /y", 0.0),
             ("\\boxed{x/y}", "x/y", 1.0), ("\\boxed{01/2}", "\\frac{1}{2}", 0.0), ("\\boxed{3", "3", 0.0), (None, "3", 0.0)]
    df = spark.createDataFrame(forms, "s string, g string, want double")
    assert [r["score"] for r in R.score_math(df, "s", "g").collect()] == [f[2] for f in forms]
    own = {("a",): lambda d: F.lit(0.25)}
    df = spark.createDataFrame([("a",)], "data_source string")
    assert R.score_rollouts(df, registry=own).first()["score"] == 0.25


def test_collect_context_position_search(spark):
    from searchlane.operators.retrieval_extras import collect_context
    doc = "intro line\nalpha beta gamma delta\nepsilon zeta eta theta\nlast one here"
    pages = spark.createDataFrame([(1, doc)], "page_id long, text string")
    snip = spark.createDataFrame([(1, "gamma delta epsilon zeta eta theta ... a b c ... alpha beta gamma delta epsilon zeta")],
                                 "page_id long, snippet string")
    ctx = collect_context(snip, pages).first()["context"]
    # the first segment spans two lines: both lines are kept as one paragraph; the
    # third segment maps to the same paragraph and is not repeated
    assert ctx == "alpha beta gamma delta\nepsilon zeta eta theta"


def test_write_metrics_long_and_wide(spark):
    from searchlane.operators.metrics import metrics_wide, write_metrics
    d = tempfile.mkdtemp(prefix="sl-metrics-")
    m1 = spark.createDataFrame([("critic/kl", 0.5), ("score", 1.0)], "metric string, value double")
    write_metrics(m1, f"{d}/m", step=1)
    write_metrics(m1.withColumn("value", F.col("value") * 2), f"{d}/m", step=2)
    wide = {r["step"]: r for r in metrics_wide(spark.read.parquet(f"{d}/m"), ["critic/kl", "score"]).collect()}
    assert wide[2]["critic/kl"] == 1.0 and wide[1]["score"] == 1.0


def test_release_scratch_removes_index_tables(spark):
    import os
    from searchlane.operators.bm25 import bm25_search, build_bm25
    from searchlane.session import _SCRATCH_TABLES, release_scratch
    corpus = spark.createDataFrame([(1, '"a"\nfoo bar'), (2, '"b"\nbaz')], "id long, contents string")
    idx = build_bm25(corpus)
    q = spark.createDataFrame([(1, "foo")], "query_id long, query string")
    assert bm25_search(q, idx, 1).count() == 1
    paths = [p for _, p in _SCRATCH_TABLES]
    assert paths and all(os.path.exists(p.replace("file:", "")) for p in paths)
    assert release_scratch(spark) >= 1
    assert not any(os.path.exists(p.replace("file:", "")) for p in paths)


def test_page_text_parser_tolerates_unclosed_p(spark):
    from searchlane.operators.retrieval_extras import page_text, page_text_regex
    html = ('<html><head><script>var t="</p>";</script></head><body>'
            '<p>first &amp; one</p><p>second <b>bold</b><p>third unclosed</body></html>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert page_text(df).first()["text"] == "first & one\nsecond bold\nthird unclosed"
    # the column form keeps unclosed paragraphs too
    assert df.select(page_text_regex("html")).first()[0] == "first &amp; one\nsecond bold\nthird unclosed"
