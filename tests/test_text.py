from pyspark.sql import functions as F

from searchlane.functions import actions as A
from searchlane.functions import text as X
from searchlane.operators import rewards as R


def one(spark, col, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


def test_normalize_answer_edge_cases(spark):
    assert one(spark, X.normalize_answer("x"), "The  éa-b a “an” apple’s") == "éab “ ” apple’s"
    assert one(spark, X.normalize_answer("x"), "the a an") == ""
    assert one(spark, X.normalize_answer("x"), "Paris! France") == "paris france"


def test_passage_split(spark):
    df = spark.createDataFrame([('"T"\nline1\nline2',), ("no break",)], "c string")
    got = df.select(X.passage_title("c").alias("t"), X.passage_title("c", True).alias("u"),
                    X.passage_text("c").alias("x")).collect()
    assert (got[0]["t"], got[0]["u"], got[0]["x"]) == ('"T"', "T", "line1\nline2")
    assert (got[1]["t"], got[1]["x"]) == ("no break", "")


def test_extract_answer_counts(spark):
    cases = ["none", "<answer>a</answer>", "<answer>a</answer> x <answer> b </answer>",
             "<answer>a</answer><answer>b</answer><answer>\nc\n</answer>"]
    got = [one(spark, A.extract_answer("x"), c) for c in cases]
    assert got == [None, None, "b", "c"]


def test_parse_action_order_and_validity(spark):
    p = lambda t, ci=False: one(spark, A.parse_action("x", ci), t)
    r = p("<answer>yes</answer> then <search>q</search>")
    assert (r["action"], r["answer"]) == ("answer", "yes")
    r = p("<searches></searches><answer>x</answer>")
    assert r["action"] is None  # empty parallel search is invalid
    r = p("<searches><search> a </search><search>b</search>")  # unclosed block
    assert (r["action"], list(r["queries"])) == ("search", ["a"])
    r = p("<searches>\n<search> a </search>\n<search></search><search>b</search></searches>")
    assert list(r["queries"]) == ["a", "b"]
    assert p("<search>   </search>")["action"] is None
    assert p("<ANSWER>x</ANSWER>")["action"] is None
    assert p("<ANSWER>x</ANSWER>", True)["action"] == "answer"


def test_valid_sequence(spark):
    head = "<|im_start|>assistant\n"
    ok = head + "<think>a</think>\n<search>q</search>\n<information>i</information>\n<think>b</think><answer>x</answer>"
    cases = {
        ok: True,
        ok.replace(head, ""): False,                                  # missing marker
        head + "<think>a</think> oops <answer>x</answer>": False,      # text between tags
        head + "<search>q</search><information>i</information><think>a</think><answer>x</answer>": False,
        head + "<think>a</think><search>q</search><information>i</information>": False,  # no answer
        head + "<think>a <b></think><answer>x</answer>\n ": True,
    }
    for text, want in cases.items():
        assert one(spark, A.valid_sequence("x"), text) is want, text


def test_subem_empty_golden_and_em(spark):
    df = spark.createDataFrame([("Paris", ["", "x"]), ("The Paris", ["paris"])], "p string, g array<string>")
    got = df.select(R.subem("p", "g").alias("s"), R.em("p", "g").alias("e")).collect()
    assert got[0]["s"] is True and got[0]["e"] is False
    assert got[1]["e"] is True


def test_gsm8k_strict_and_flexible(spark):
    df = spark.createDataFrame([("so #### 1,234", "1234"), ("a 12 then 1,234.", "1234"), ("only . here", "1")],
                               "s string, g string")
    st = [r[0] for r in df.select(R.gsm8k_answer("s", "strict")).collect()]
    fl = [r[0] for r in df.select(R.gsm8k_answer("s", "flexible")).collect()]
    assert st == ["1234", None, None]
    assert fl == ["1,234", "1,234.", "."]


def test_countdown_and_math(spark):
    df = spark.createDataFrame([
        ("<|im_start|>assistant\nx\n<answer>(3 + 4) * 2</answer>", 14.0, [2, 3, 4]),
        ("<|im_start|>assistant\n<answer>3 + 4</answer>", 7.0, [3, 4, 4]),
        ("<|im_start|>assistant\n<answer>__import__('os')</answer>", 1.0, [1]),
        ("no marker", 1.0, [1])], "s string, t double, n array<int>")
    got = [r["score"] for r in R.score_countdown(df, "s", "t", "n").collect()]
    assert got == [1.0, 0.1, 0.1, 0.0]
    m = spark.createDataFrame([("\\boxed{\\dfrac12}", "\\frac{1}{2}"), ("\\boxed{0.5}", "\\frac{1}{2}"),
                               ("\\boxed{3}", "4"), ("no box", "1")], "s string, g string")
    assert [r["score"] for r in R.score_math(m, "s", "g").collect()] == [1.0, 1.0, 0.0, 0.0]


def test_quota_and_snippet(spark):
    assert one(spark, X.is_quota_error("x"), "Insufficient BALANCE") is True
    assert one(spark, X.is_quota_error("x"), "账户余额不足") is True
    assert one(spark, X.is_quota_error("x"), None) is False
    segs = one(spark, X.parse_snippet("x"), "one two three four five six ... short one ... a b c d e f g")
    assert list(segs) == ["one two three four five six", "a b c d e f g"]


def test_convert_title_format(spark):
    assert one(spark, X.convert_title_format("x"), "(Title: Foo) body\nmore") == '"Foo"\nbody\nmore'
    assert one(spark, X.convert_title_format("x"), "plain") == "plain"


def test_dispatch_unknown_source_raises(spark):
    import pytest
    df = spark.createDataFrame([("nope", "<answer>a</answer>", ["a"])], "data_source string, full_sequence string, golden_answers array<string>")
    with pytest.raises(Exception):
        R.score_rollouts(df).collect()
    ok = df.withColumn("data_source", F.lit("nq"))
    assert R.score_rollouts(ok).first()["score"] == 0.0


def test_format_reason_matches_flag(spark):
    from searchlane.functions.actions import format_reason
    head = "<|im_start|>assistant\n"
    cases = {
        "no marker": "Missing assistant marker",
        head + "<think>a</think><answer>x": "Mismatch in answer tags: 1 opening vs 0 closing tags",
        head + "<think>a</think> oops <answer>x</answer>": "Unexpected content 'oops' between tags (state: after_think)",
        head + "<search>q</search>": "Unexpected tag <search> in state start",
        head + "<think>a</think>": "Incomplete sequence, ended in state after_think",
        head + "<think>a</think><answer>x</answer> tail": "Unexpected content in state end",
        head + "<think>a</think><search>q</search><information>i</information><think>b</think><answer>x</answer>":
            "Valid sequence format",
    }
    df = spark.createDataFrame([(t,) for t in cases], "x string")
    got = {r["x"]: (r["reason"], r["ok"]) for r in
           df.select("x", format_reason("x").alias("reason"), A.valid_sequence("x").alias("ok")).collect()}
    for t, want in cases.items():
        assert got[t][0] == want, t
        assert got[t][1] is (want == "Valid sequence format"), t
