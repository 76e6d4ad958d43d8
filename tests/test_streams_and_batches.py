"""Sessions, bucketed resume, malformed lines, popped columns and masks."""
import time

import pytest
from pyspark.sql import functions as F

from searchlane.operators.batching import pop_columns, select_rows
from searchlane.sources import io
from searchlane.sources.tables import Tables
from searchlane.streaming import jobs
from tests.conftest import SF_SMALL


def test_sessions_of_a_stream_equal_the_batch(spark, tmp_path):
    ev = Tables(spark, SF_SMALL).events
    last = ev.agg(F.max("ts")).first()[0]
    for i, part in enumerate((ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = jobs.start(jobs.session_scores(stream, gap="6 hours", delay="1000 days"), "memory:x4_sessions",
                   checkpoint=f"{tmp_path}/ck", output_mode="complete")
    assert q.awaitTermination(100)
    got = {(r.user_id, r.session.start, r.session.end, r.n) for r in spark.sql("SELECT * FROM x4_sessions").collect()}
    want = {(r.user_id, r.session.start, r.session.end, r.n) for r in jobs.session_scores_batch(ev, gap="6 hours").collect()}
    assert got == want and last is not None and any(n > 1 for *_, n in want)


def test_a_row_between_two_sessions_merges_them(spark):
    rows = [(1, "10:00"), (1, "10:40"), (1, "10:20"), (1, "12:00"), (2, "10:00"), (None, "10:00")]
    df = spark.createDataFrame([(u, f"2024-01-01 {t}:00", 1.0) for u, t in rows], "user_id long, ts string, value double") \
        .withColumn("ts", F.to_timestamp("ts"))
    got = sorted((r.user_id, r.session.start.hour, r.n) for r in jobs.session_scores_batch(df).collect())
    assert got == [(1, 10, 3), (1, 12, 1), (2, 10, 1)]


def test_resume_reads_only_the_buckets_of_the_batch(spark, tmp_path):
    sink, path = jobs.resume_sink(str(tmp_path / "done")), str(tmp_path / "done")
    keys = [f"k{i}" for i in range(200)]
    sink(spark.createDataFrame([(k,) for k in keys] + [(None,)], "sample_key string"), 0)
    for _ in range(2):  # a replayed batch overwrites itself
        sink(spark.createDataFrame([("k7",), ("new",), ("new",), (None,)], "sample_key string"), 1)
    done = spark.read.parquet(path)
    assert sorted(r.sample_key for r in done.where("batch_id = 1 and sample_key is not null").collect()) == ["new"]
    assert done.where("sample_key is null").count() == 2
    bucket = done.where("sample_key = 'k7'").first().bucket
    plan = jobs.completed_keys(spark, path, [bucket], 1)
    assert 0 < plan.count() < 20  # the files of the other buckets are pruned
    assert "PartitionFilters: [" in (text := plan._jdf.queryExecution().executedPlan().toString()) and "bucket" in text


def test_malformed_json_lines_are_an_error(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1", "contents": "a"}\n\n{"id": "2", "contents": "b"}\n')
    assert io.read_jsonl(spark, str(tmp_path), io.CORPUS_SCHEMA).count() == 2
    (tmp_path / "y.jsonl").write_text('{"id": "3", "contents":\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_jsonl(spark, str(tmp_path), io.CORPUS_SCHEMA).collect()


def test_pop_and_mask(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", False)], "i int, `x.y` string, m boolean")
    taken, rest = pop_columns(df, ["x.y"])
    assert (taken.columns, rest.columns) == (["x.y"], ["i", "m"])
    with pytest.raises(ValueError, match="nope"):
        pop_columns(df, ["i", "nope"])
    assert [r.i for r in select_rows(df, "m").collect()] == [1] and select_rows(df, F.col("i") > 5).count() == 0
    with pytest.raises(Exception, match="mask"):
        select_rows(df.withColumn("m", F.lit(None).cast("boolean")), "m").collect()
