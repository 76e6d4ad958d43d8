"""Structured Streaming jobs.

The reference has append-only logs, resumable jobs and a turn-by-turn state
machine; these are their streaming forms. Every job checkpoints into the
shared ``spark.checkpoint.dir`` (or a location the caller gives).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from searchlane.functions.actions import parse_action
from searchlane.operators.result_cache import ResultCache
from searchlane.operators.rewards import score_rollouts
from searchlane.session import scratch_path


def read_log_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json",
                    max_files: int = 100) -> DataFrame:
    """Source: a directory that receives appended rollout-log files."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .format(fmt).load(path))


def incremental_scores(stream: DataFrame, registry: str = "em") -> DataFrame:
    """Score each newly arrived rollout record (same Column logic as R9)."""
    return score_rollouts(stream, registry=registry)


def dedupe_by_key(stream: DataFrame, key: str = "sample_key", ts: str = "ts",
                  delay: str = "1 hour") -> DataFrame:
    """Late duplicates of a sample key are dropped within the watermark; rows without
    a key are no duplicates of each other and all stay (a random id is their key)."""
    own = F.coalesce(F.concat(F.lit("k:"), F.col(key).cast("string")), F.expr("concat('n:', uuid())"))
    return (stream.withWatermark(ts, delay).withColumn("_dedupe_key", own)
            .dropDuplicatesWithinWatermark(["_dedupe_key"]).drop("_dedupe_key"))


def _table_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))


#: hash buckets of the completed keys: a micro-batch reads only those its keys fall into
KEY_BUCKETS = 256


def _bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(KEY_BUCKETS)).cast("int")


def completed_keys(spark: SparkSession, done_path: str, buckets: list[int], before: int) -> DataFrame:
    """Keys of the named buckets that batches before ``before`` completed; files of other
    buckets are pruned as partitions."""
    return (spark.read.parquet(done_path).where(F.col("bucket").isin(buckets) & (F.col("batch_id") < before))
            .select("sample_key").where("sample_key is not null"))


def resume_sink(done_path: str):
    """X2 (beyond the watermark): each micro-batch is anti-joined with the completed-key
    table and only new keys are written, into a partition of the batch id that a replay
    overwrites. The table is cut by a hash of the key, and only the buckets of the batch's keys
    are read, at most ``KEY_BUCKETS`` numbers through the driver. Rows without a key are always kept."""
    def write(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        keyed = batch.filter(F.col("sample_key").isNotNull()).withColumn("bucket", _bucket("sample_key"))
        bare = batch.filter(F.col("sample_key").isNull()).withColumn("bucket", F.lit(-1))
        if _table_exists(spark, done_path):  # a failed read fails the batch; it never counts as "no table yet"
            asked = [r.bucket for r in keyed.select("bucket").distinct().collect()]
            keyed = keyed.join(completed_keys(spark, done_path, asked, batch_id), "sample_key", "left_anti")
        keyed.dropDuplicates(["sample_key"]).unionByName(bare).repartition("bucket").write.mode("overwrite") \
            .partitionBy("bucket").parquet(f"{done_path.rstrip('/')}/batch_id={batch_id}")
    return write


def windowed_scores(stream: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value",
                    window: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Event-time tumbling (or sliding) window mean per key; rows behind the
    watermark are dropped (our rule, documented)."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (stream.withWatermark(ts, delay).groupBy(w.alias("window"), key)
            .agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n")))


def windowed_scores_batch(df: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value",
                          window: str = "1 hour") -> DataFrame:
    """X4 batch equivalent (same aggregation, no watermark)."""
    return (df.groupBy(F.window(ts, window).alias("window"), key)
            .agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n")))


def session_scores(stream: DataFrame, ts: str = "ts", key: str = "user_id", value: str = "value",
                   gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """X4, sessions: rows of a key less than ``gap`` apart make one session, which grows and
    merges as rows arrive (late ones too, within the watermark) and is out once the watermark
    passes its end. Rows without a key or a time are left out."""
    return (stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
            .groupBy(F.session_window(ts, gap).alias("session"), key)
            .agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n")))


def session_scores_batch(df: DataFrame, ts: str = "ts", key: str = "user_id", value: str = "value",
                         gap: str = "30 minutes") -> DataFrame:
    """X4, sessions of a whole table: the same aggregate, which Spark merges from sorted partial
    sessions, so no key's rows are collected."""
    return (df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
            .groupBy(F.session_window(ts, gap).alias("session"), key)
            .agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------------ X3
#: seen: an action's first letter for each step (a, s, other; '.' not seen yet)
STATE_SCHEMA = "seen string, status string, deadline long"
OUT_SCHEMA = ("sample_id long, turns long, valid_actions long, valid_searches long, active boolean, "
              "collector_status string")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def turn_counts(seen: str, max_turns: int) -> tuple[int, int, int, bool, bool]:
    """(turns, valid actions, valid searches, answered, complete) of the steps seen so far, by
    the replay's rules (A6): nothing counts after the first answer. Complete: every step up
    to the answer, or up to the last one allowed, has been seen."""
    answer = seen.find("a")
    counted = seen if answer < 0 else seen[:answer + 1]
    complete = "." not in counted
    reached = len(seen) - seen.count(".") if answer < 0 else answer
    return (1 + min(reached, max_turns), counted.count("a") + counted.count("s"), counted.count("s"), answer >= 0, complete)


class _TurnState(StatefulProcessor):
    """One value a sample: the steps seen, and once it is finished a tombstone that turns of
    the sample which come later leave as it is."""

    def __init__(self, max_turns: int, timeout_ms: int | None, keep_ms: int):
        self.max_turns, self.timeout_ms, self.keep_ms = max_turns, timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sample", STATE_SCHEMA, self.keep_ms)

    def _row(self, key, seen: str, status: str) -> pd.DataFrame:
        turns, valid, searches, answered, _ = turn_counts(seen, self.max_turns)
        return pd.DataFrame({"sample_id": [key[0]], "turns": [turns], "valid_actions": [valid],
                             "valid_searches": [searches], "active": [not answered], "collector_status": [status]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        seen, status, deadline = held if held is not None else ("." * (self.max_turns + 1), "running", 0)
        if status != "running":
            for _ in rows:
                pass
            return
        steps = list(seen)
        for pdf in rows:
            for step, action in zip(pdf["step"], pdf["action"]):
                if 0 <= step <= self.max_turns and steps[step] == ".":  # a step counts once
                    steps[step] = {"answer": "a", "search": "s"}.get(action, "x")
        seen = "".join(steps)
        *_, answered, complete = turn_counts(seen, self.max_turns)
        if complete:
            status = "completed" if answered else "failed"
        elif self.timeout_ms:
            deadline = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(deadline)
        self.state.update((seen, status, deadline))
        yield self._row(key, seen, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        if held is None or held[1] != "running" or held[2] > expiredTimerInfo.getExpiryTimeInMs():
            return  # finished, or a later turn has moved the deadline
        self.state.update((held[0], "failed", held[2]))
        yield self._row(key, held[0], "failed")

    def close(self) -> None:
        pass


def rollout_state(stream: DataFrame, max_turns: int, sample: str = "sample_id", step: str = "step",
                  text: str = "response", ts: str = "ts", timeout_ms: int | None = None,
                  keep_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """Turn-by-turn rollout state keyed by sample, as the replay (A6) computes it, in a
    RocksDB state store.

    Steps of one sample may arrive in any order and in any micro-batches; a repeated step
    counts once. A sample is reported as running until every step up to its answer (or up to
    ``max_turns``) is there, then once as completed or failed. After that its state is a
    tombstone: later turns change and report nothing. With ``timeout_ms`` a sample without
    a new turn for so long fails. State is dropped ``keep_ms`` after its last change, so a turn
    later than that starts a new sample."""
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # lists, timers and TTL need it
    parsed = stream.select(F.col(sample).cast("long").alias("sample_id"), F.col(step).cast("int").alias("step"),
                           parse_action(text)["action"].alias("action")).where("sample_id is not null and step is not null")
    return parsed.groupBy("sample_id").transformWithStateInPandas(
        _TurnState(max_turns, timeout_ms, keep_ms), OUT_SCHEMA, "Update", "ProcessingTime")


# ------------------------------------------------------------------ X5
def cached_retrieval_sink(retrieve_fn, cache_path: str, answer_path: str, query_col: str = "query"):
    """X5 in ``foreachBatch``: a micro-batch's queries are joined with the cached results as
    they are now, misses are retrieved, every request is answered, and the new results join
    the cache. Both writes go to a partition of the batch id, so a replay repeats neither."""
    def write(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        asked = batch.select(query_col).distinct()
        if _table_exists(spark, cache_path):
            known = spark.read.parquet(cache_path).filter(F.col("batch_id") < batch_id).drop("batch_id")
            misses = asked.join(known.select(query_col).distinct(), query_col, "left_anti")
        else:
            known, misses = None, asked
        part = f"{cache_path.rstrip('/')}/batch_id={batch_id}"
        retrieve_fn(misses).write.mode("overwrite").parquet(part)
        fresh = spark.read.parquet(part)
        hits = fresh if known is None else known.unionByName(fresh)
        batch.join(hits, query_col, "left").write.mode("overwrite").parquet(f"{answer_path.rstrip('/')}/batch_id={batch_id}")
    return write


def bounded_retrieval_sink(retrieve_fn, cache: ResultCache, answer_path: str):
    """X5 with a bounded cache: a micro-batch's queries meet the cache's current snapshot, only
    misses are retrieved, and a new snapshot with the least recently used evicted is published
    before the answers are written. A replayed batch finds its results in the cache."""
    def write(batch: DataFrame, batch_id: int):
        cache.answer(batch, retrieve_fn, batch_id).write.mode("overwrite").parquet(
            f"{answer_path.rstrip('/')}/batch_id={batch_id}")
    return write


def start(query_df: DataFrame, sink, name: str | None = None, checkpoint: str | None = None,
          output_mode: str = "append", trigger_once: bool = True):
    """Start a streaming query with a checkpoint under the shared folder. A query with
    processing-time timers (X3) asks for batches without data for ever: with ``trigger_once`` it
    runs none, so that it ends with its data, and timers that are due fire in the next run."""
    name = name or (sink.split(":", 1)[1] if isinstance(sink, str) and ":" in sink else "job")
    ck = checkpoint or scratch_path(query_df.sparkSession, f"stream-{name}")
    conf, idle = query_df.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before, timed = conf.get(idle), "TransformWithState" in query_df._jdf.queryExecution().analyzed().toString()
    if trigger_once and timed:
        conf.set(idle, "false")  # read when the query starts
    try:
        return _start(query_df.writeStream.option("checkpointLocation", ck).outputMode(output_mode), sink, trigger_once)
    finally:
        conf.set(idle, before)


def _start(w, sink, trigger_once: bool):
    if trigger_once:
        w = w.trigger(availableNow=True)
    if callable(sink):
        return w.foreachBatch(sink).start()
    if isinstance(sink, str) and sink.startswith("memory:"):
        return w.format("memory").queryName(sink.split(":", 1)[1]).start()
    return w.format("parquet").option("path", sink).start()
