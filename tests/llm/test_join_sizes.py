"""Joins with tables that hold far more rows than their files' bytes tell are not broadcast."""

from searchlane.llm import op3_substring_dedup as o3
from searchlane.llm import op5_simhash_golay as o5
from searchlane.llm import op8_mix_sources as o8


def joins(df, of):
    """The join nodes of a plan whose line names ``of``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("[")[0].strip(" +-:*") for line in plan.splitlines() if "Join" in line and of in line]


def test_simhash_keys_are_not_broadcast(spark, tmp_path):
    spark.range(2000).selectExpr("xxhash64(id) as fp").write.parquet(f"{tmp_path}/classes")
    found = joins(o5.near_links(spark.read.parquet(f"{tmp_path}/classes")), "key#")
    assert found and all("SortMergeJoin" in x for x in found)


def test_spans_are_not_broadcast(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, passage + " one"), (2, "two " + passage)], "doc_id long, text string")
    out = o3.substring_dedup(docs)
    found = joins(out, "src_rid#")
    assert found and all("SortMergeJoin" in x for x in found)
    assert [tuple(r) for r in out.select("doc_id", "n_removed").orderBy("doc_id").collect()] == [(1, 0), (2, 20)]


def test_slots_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, "w " * 300, "a" if i % 2 else "b") for i in range(9)], "doc_id long, text string, source string")
    found = joins(o8.mix(docs), "block#")
    assert found and all("SortMergeJoin" in x for x in found)
