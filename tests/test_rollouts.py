import re

from pyspark.sql import functions as F

from searchlane.operators import rollouts as RO
from searchlane.sources import fixtures as fx
from searchlane.sources.tables import Tables
from tests.conftest import SF_SMALL

RX = re.compile(r"<searches>(.*?)</searches>|<search>(.*?)</search>|<answer>(.*?)</answer>", re.S)


def py_action(t):
    m = RX.search(t)
    if not m:
        return None
    if m.group(0).startswith("<searches>"):
        qs = [q.strip() for q in re.findall(r"<search>(.*?)</search>", m.group(1), re.S) if q.strip()]
        return "search" if qs else None
    if m.group(0).startswith("<search>"):
        return "search" if m.group(2).strip() else None
    return "answer"


def simulate(responses, max_turns):
    """Direct re-implementation of the turn loop (the replay must agree)."""
    active, turns, va, vs = True, 1, 0, 0
    for step in range(max_turns + 1):
        if not active:
            break
        a = py_action(responses[step]) if step < len(responses) else None
        done = a == "answer"
        va += a in ("answer", "search")
        vs += a == "search"
        if step < max_turns and not done:
            turns += 1
        active = not done
    return turns, va, vs, active


def test_replay_matches_loop_simulation(spark):
    r = fx.responses(Tables(spark, SF_SMALL))
    got = {x["sample_id"]: (x["turns"], x["valid_actions"], x["valid_searches"], x["active"])
           for x in RO.replay_rollouts(r, 2).collect()}
    by = {}
    for row in r.orderBy("sample_id", "turn_idx").collect():
        by.setdefault(row["sample_id"], []).append(row["response"])
    for sid, resp in by.items():
        assert got[sid] == simulate(resp, 2), sid


def test_truncate_messages_budget(spark):
    m = spark.createDataFrame([(1, 0, "a b c d"), (1, 1, "e f"), (1, 2, "g h i"),
                               (2, 0, "x y z w")], "sample_id int, msg_idx int, content string")
    out = {(r["sample_id"], r["msg_idx"]): r["content"] for r in RO.truncate_messages(m, 6).collect()}
    assert out == {(1, 2): "g h i", (1, 1): "e f", (2, 0): "x y z w"}  # the oldest message goes whole
    out = {(r["sample_id"], r["msg_idx"]): r["content"] for r in RO.truncate_messages(m, 2).collect()}
    assert out == {(1, 2): "h i", (2, 0): "z w"}  # only a last message is cut
    exact = RO.truncate_messages(m.filter("sample_id = 1"), 9).collect()
    assert len(exact) == 3


def test_sample_key_and_resume_idempotent(spark):
    df = spark.createDataFrame([("u1", 1), (" ", 2), ("NaN", 3), (None, None), ("None", 5)], "uid string, index long")
    keys = [r["k"] for r in df.select(RO.sample_key().alias("k")).collect()]
    assert keys == ["uid:u1", "index:2", "index:3", None, "index:5"]
    prompts = df.withColumn("sample_key", RO.sample_key())
    done = prompts.filter(F.col("index") <= 2)
    once = RO.resume_pending(prompts, done)
    twice = RO.resume_pending(once, done)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.filter(F.col("sample_key").isNull()).count() == 1  # null key is never skipped


def test_format_observation_headers(spark):
    from searchlane.operators.observe import format_observation
    pq = spark.createDataFrame([(1, 0, "q1", " r1 "), (2, 0, "qa", "ra"), (2, 1, "qb", "rb\n")],
                               "k int, qpos int, query string, result string")
    out = {r["k"]: r["observation"] for r in format_observation(pq, "k").collect()}
    assert out[1] == "r1"
    assert out[2] == "[Search 1] Query: qa\nra\n\n[Search 2] Query: qb\nrb"


def test_zip_batches_checks_shared_columns(spark):
    import pytest
    a = spark.createDataFrame([(1, 5, "x")], "row_id int, b int, c string")
    b = spark.createDataFrame([(1, 6, 2.0)], "row_id int, b int, d double")
    with pytest.raises(Exception):
        RO.zip_batches(a, b).collect()
    with pytest.raises(Exception):  # a row without a partner
        RO.zip_batches(a.union(a.withColumn("row_id", F.lit(2))), b.withColumn("b", F.lit(5))).collect()
    ok = RO.zip_batches(a, b.withColumn("b", F.lit(5))).first()
    assert (ok["c"], ok["d"]) == ("x", 2.0)


class _EchoModel:
    def generate(self, prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("quota exceeded: insufficient balance")
        return [{"text": p.upper(), "finish_reason": "stop", "usage": len(p)} for p in prompts]


def test_generate_captures_errors(spark):
    df = spark.createDataFrame([(1, "hi"), (2, "boom"), (3, "ok")], "sample_id long, prompt_text string")
    out = {r["sample_id"]: r for r in RO.generate(df, _EchoModel).collect()}
    assert out[1]["text"] == "HI" and out[1]["error"] is None
    assert out[2]["text"] is None and "insufficient balance" in out[2]["error"]
    from searchlane.functions.text import is_quota_error
    flagged = RO.generate(df, _EchoModel).filter(is_quota_error("error")).count()
    assert flagged == 1
