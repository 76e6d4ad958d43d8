import numpy as np
import pytest
from pyspark.sql import functions as F

from searchlane.functions import rl
from searchlane.operators import advantages as ADV


def test_gae_gamma_lambda_one_is_suffix_sum_minus_value(spark):
    r, v = [0.0, 0.5, 1.0, 2.0], [0.3, 0.1, 0.7, 0.2]
    df = spark.createDataFrame([(r, v)], "r array<double>, v array<double>")
    g = df.select(rl.gae("r", "v", 1.0, 1.0).alias("g")).first()["g"]
    want = [sum(r[i:]) - v[i] for i in range(4)]
    assert np.allclose(g["advantages"], want)
    assert np.allclose(g["returns"], np.array(want) + np.array(v))


def test_gae_matches_python_recursion(spark):
    rng = np.random.default_rng(0)
    r, v = rng.normal(size=6).tolist(), rng.normal(size=6).tolist()
    gamma, lam = 0.9, 0.8
    last, adv = 0.0, []
    for t in reversed(range(6)):
        nv = v[t + 1] if t < 5 else 0.0
        last = r[t] + gamma * nv - v[t] + gamma * lam * last
        adv.append(last)
    df = spark.createDataFrame([(r, v)], "r array<double>, v array<double>")
    got = df.select(rl.gae("r", "v", gamma, lam).alias("g")).first()["g"]["advantages"]
    assert got == adv[::-1]


def test_whitening_zero_mean_and_errors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0], [1, 1, 1]), (0, [4.0, 5.0], [1, 1])],
                               "batch_id int, a array<double>, m array<int>")
    w = ADV.masked_whiten(df, "a", "m").collect()
    vals = [x for row in w for x in row["a"]]
    assert abs(np.mean(vals)) < 1e-9
    assert abs(np.var(vals, ddof=1) - 1.0) < 1e-6
    one = spark.createDataFrame([(0, [1.0, 2.0], [1, 0])], "batch_id int, a array<double>, m array<int>")
    with pytest.raises(Exception):
        ADV.masked_whiten(one, "a", "m").collect()
    zero = spark.createDataFrame([(0, [1.0], [0])], "batch_id int, a array<double>, m array<int>")
    with pytest.raises(Exception):
        ADV.masked_whiten(zero, "a", "m").collect()


def test_grpo_singleton_and_equal_groups(spark):
    df = spark.createDataFrame([
        (1, "g1", [0.0, 2.0], [1, 1]),
        (2, "g2", [0.0, 1.0], [1, 1]), (3, "g2", [0.0, 1.0], [1, 1]),
        (4, "g3", [0.0, 1.0], [1, 1]), (5, "g3", [0.0, 3.0], [1, 0])],
        "row_id int, group_id string, token_level_rewards array<double>, attention_mask array<int>")
    out = {r["row_id"]: r for r in ADV.compute_grpo(df).collect()}
    assert out[1]["grpo_score"] == pytest.approx(2.0 / (1 + 1e-6))
    assert out[2]["grpo_score"] == 0.0 and out[3]["grpo_score"] == 0.0
    sd = np.std([1.0, 3.0], ddof=1)
    assert out[5]["grpo_score"] == pytest.approx((3.0 - 2.0) / (sd + 1e-6))
    assert out[5]["advantages"][1] == 0.0


def test_kl_kinds_and_masks(spark):
    df = spark.createDataFrame([([-1.0, -2.0], [-1.5, -1.0], [5, 2, 7, 2, 9], [1, 1, 0])],
                               "lp array<double>, ref array<double>, ids array<int>, m array<int>")
    r = df.select(rl.kl_penalty("lp", "ref", "kl").alias("kl"), rl.kl_penalty("lp", "ref", "low_var_kl").alias("lv"),
                  rl.eos_mask("ids", 2).alias("eos"), rl.position_ids("m").alias("pos"),
                  rl.attention_mask("ids", 7).alias("am")).first()
    assert r["kl"] == [0.5, -1.0]
    kl = -1.0 - (-1.5)
    assert r["lv"][0] == pytest.approx(min(max(np.exp(-kl) + kl - 1, -10), 10))
    assert r["eos"] == [1, 1, 0, 0, 0]
    assert r["pos"] == [0, 1, 0]
    assert r["am"] == [1, 1, 0, 1, 1]
    with pytest.raises(NotImplementedError):
        rl.kl_penalty("lp", "ref", "full")


def test_token_level_scores_and_entropy(spark):
    df = spark.createDataFrame([(2.0, [1, 1, 1, 0], [0.0, 1.0, 2.0])], "s double, m array<int>, l array<double>")
    r = df.select(rl.token_level_scores("s", "m").alias("t"), rl.entropy_from_logits("l").alias("h"),
                  rl.logprob_of_label("l", F.lit(2)).alias("lp")).first()
    assert r["t"] == [0.0, 0.0, 2.0, 0.0]
    p = np.exp([0.0, 1.0, 2.0]) / np.exp([0.0, 1.0, 2.0]).sum()
    assert r["h"] == pytest.approx(-(p * np.log(p)).sum())
    assert r["lp"] == pytest.approx(np.log(p[2]))


def test_adaptive_kl(spark):
    steps = spark.createDataFrame([(0, 0, 0.2, 10), (0, 1, 0.05, 10), (0, 2, 0.1, 10)],
                                  "run_id int, step int, kl double, batch_size int")
    got = [r["kl_coef"] for r in ADV.adaptive_kl_coefficients(steps, 0.1, 0.1, 100.0).orderBy("step").collect()]
    v, want = 0.1, []
    for kl in (0.2, 0.05, 0.1):
        want.append(v)
        v *= 1 + np.clip(kl / 0.1 - 1, -0.2, 0.2) * 10 / 100.0
    assert got == pytest.approx(want)
