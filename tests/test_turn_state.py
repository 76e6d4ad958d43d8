"""Turn state across micro-batches, tombstones, timeouts, and equality with the replay."""
import random
import time

import pytest

from searchlane.operators.rollouts import replay_rollouts
from searchlane.streaming import jobs

SCHEMA = "sample_id long, step int, response string"
ANSWER, SEARCH, BAD = ("<answer>a</answer> <answer>b</answer>", "<search>q</search>", "no tags")
COLS = ("turns", "valid_actions", "valid_searches", "active", "collector_status")


def run(spark, folder, batches, name, **options):
    """Each batch is a file and a micro-batch of its own; returns every reported row in order."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    seen = []

    def sink(df, batch_id):
        seen.extend((r.sample_id, *(r[c] for c in COLS)) for r in df.collect())

    query = jobs.start(jobs.rollout_state(stream, 2, **options), sink, name, f"{folder}/ck", "update")
    if not query.awaitTermination(60):
        query.stop()
        raise TimeoutError("the stream did not end with its data")
    return seen


def test_turns_after_an_answer_change_nothing(spark, tmp_path):
    batches = [[(1, 0, SEARCH), (1, 1, ANSWER), (2, 0, SEARCH)], [(1, 2, SEARCH), (1, 0, BAD), (2, 1, BAD)],
               [(2, 2, SEARCH), (3, 5, ANSWER)], [(2, 0, ANSWER), (1, 1, BAD)]]
    got = run(spark, tmp_path, batches, "tombstone")
    assert [r for r in got if r[0] == 1] == [(1, 2, 2, 1, False, "completed")]
    assert [r for r in got if r[0] == 2] == [(2, 2, 1, 1, True, "running"), (2, 3, 1, 1, True, "running"),
                                             (2, 3, 2, 2, True, "failed")]
    assert [r for r in got if r[0] == 3] == [(3, 1, 0, 0, True, "running")]  # a step beyond the last allowed


def test_any_order_of_arrival_equals_the_replay(spark, tmp_path):
    rng = random.Random(2)
    rows = [(s, t, rng.choice([ANSWER, SEARCH, SEARCH, BAD])) for s in range(40) for t in range(4)]
    shuffled = rng.sample(rows, len(rows))
    got = run(spark, tmp_path, [shuffled[:60], shuffled[60:110], shuffled[110:]], "order")
    last = {r[0]: r[1:] for r in got}
    table = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("step", "turn_idx")
    want = {r.sample_id: tuple(r[c] for c in COLS[:4]) for r in replay_rollouts(table, 2).collect()}
    assert {s: r[:4] for s, r in last.items()} == want
    assert all((r[4] == "completed") == (not r[3]) and r[4] != "running" for r in last.values())
    assert len([r for r in got if r[5] != "running"]) == 40  # the end of a sample is reported once


def test_abandoned_samples_fail_and_are_forgotten(spark, tmp_path):
    first = run(spark, tmp_path, [[(1, 0, SEARCH), (2, 0, ANSWER)]], "wait", timeout_ms=500, keep_ms=4000)
    assert sorted(first) == [(1, 2, 1, 1, True, "running"), (2, 1, 1, 0, False, "completed")]
    second = run(spark, tmp_path, [[(3, 0, SEARCH)]], "wait", timeout_ms=500, keep_ms=4000)
    assert (1, 2, 1, 1, True, "failed") in second and not any(r[0] == 2 for r in second)
    time.sleep(4)
    third = run(spark, tmp_path, [[(2, 0, SEARCH)]], "wait", timeout_ms=500, keep_ms=4000)
    assert (2, 2, 1, 1, True, "running") in third  # the tombstone's time is over: a new sample


@pytest.mark.parametrize("seen, want", [
    ("...", (1, 0, 0, False, False)), ("s..", (2, 1, 1, False, False)), ("sa.", (2, 2, 1, True, True)),
    (".a.", (2, 1, 0, True, False)), ("sxs", (3, 2, 2, False, True)), ("ass", (1, 1, 0, True, True))])
def test_counts(seen, want):
    assert jobs.turn_counts(seen, 2) == want
