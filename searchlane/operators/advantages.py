"""Batch-level RL maths over token-array tables.

Per-row work is higher-order array functions; batch statistics are partial
(map-side) aggregates keyed by ``batch_id`` or group, joined back as small
size-checked broadcasts. No window runs without a partition key and no group
is ever collected into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlane.functions import rl
from searchlane.operators.common import bounded_broadcast
from searchlane.session import materialise


def response_mask(df: DataFrame, mask_col: str = "attention_mask") -> Column:
    return F.col(mask_col)


def add_token_level_scores(df: DataFrame, score_col: str = "score",
                           mask_col: str = "attention_mask") -> DataFrame:
    """Scalar score on the last valid token; a model score column
    ``rm_scores`` (already token level) takes precedence when present."""
    tls = rl.token_level_scores(score_col, mask_col)
    if "rm_scores" in df.columns:
        tls = F.coalesce(F.col("rm_scores"), tls)
    return df.withColumn("token_level_scores", tls)


def apply_kl_penalty(df: DataFrame, beta: float, kind: str = "kl", mask_col: str = "info_mask",
                     logprob_col: str = "old_log_probs", ref_col: str = "ref_log_prob") -> DataFrame:
    """M8: token_level_rewards = scores - beta * kl * mask; ``seq_kl`` is the
    masked mean KL of the row (batch KL = mean of ``seq_kl``)."""
    m = F.col(mask_col)
    if ref_col in df.columns:
        kld = F.zip_with(rl.kl_penalty(logprob_col, ref_col, kind), m, lambda k, x: k * x)
        b = beta
    else:
        kld = F.transform(m, lambda x: F.lit(0.0))
        b = 0.0
    out = df.withColumn("kld", kld)
    out = out.withColumn("token_level_rewards",
                         F.zip_with("token_level_scores", "kld", lambda s, k: s - F.lit(b) * k))
    den = rl.array_sum(m)
    # an all-masked row gives NaN (0/0), as a tensor masked mean does
    return out.withColumn("seq_kl", F.when(den == 0, F.lit(float("nan")))
                          .otherwise(F.try_divide(rl.masked_sum("kld", mask_col), den)))


def batch_kl(df: DataFrame, by: str = "batch_id") -> DataFrame:
    """M8 batch metric: mean over rows of the row-level masked-mean KL."""
    return df.groupBy(by).agg(F.avg("seq_kl").alias("kl"), F.count(F.lit(1)).alias("batch_size"))


def adaptive_kl_coefficients(steps: DataFrame, init_coef: float, target: float, horizon: float,
                             run_col: str = "run_id", step_col: str = "step",
                             kl_col: str = "kl", n_col: str = "batch_size",
                             adaptive: bool = True) -> DataFrame:
    """M9: coefficient in force at each step.

    Adaptive: value *= 1 + clip(kl/target - 1, -0.2, 0.2) * n / horizon after
    each step, i.e. coef_t = init * prod_{s<t} mult_s, computed as
    exp(sum(ln mult)) over a window partitioned by run (one row per training
    step; the step table is small and bounded by the number of steps).
    """
    if not adaptive:
        return steps.withColumn("kl_coef", F.lit(float(init_coef)))
    err = F.least(F.greatest(F.col(kl_col) / F.lit(target) - 1.0, F.lit(-0.2)), F.lit(0.2))
    mult = 1.0 + err * F.col(n_col) / F.lit(horizon)
    w = Window.partitionBy(run_col).orderBy(step_col).rowsBetween(Window.unboundedPreceding, -1)
    return (steps.withColumn("_lm", F.log(mult))
            .withColumn("kl_coef", F.lit(float(init_coef)) * F.exp(F.coalesce(F.sum("_lm").over(w), F.lit(0.0))))
            .drop("_lm"))


def masked_whiten(df: DataFrame, col: str, mask_col: str, by: str = "batch_id",
                  out: str | None = None) -> DataFrame:
    """Whiten over the *whole batch*: masked mean and Bessel-corrected
    variance, ``(x - mean) * rsqrt(var + 1e-8)`` for every token. A batch whose
    mask sums to 0 or 1 raises."""
    out = out or col
    n = rl.array_sum(mask_col)
    mean = rl.masked_mean(col, mask_col)
    per_row = df.select(by, n.alias("_n"), F.when(n > 0, mean).otherwise(0.0).alias("_m"),
                        F.when(n > 0, rl.masked_var(col, mask_col, unbiased=False) * n).otherwise(0.0).alias("_s"))
    # counts, means and centred squares of the rows merge in one partial aggregate per batch
    total = F.sum("_n")
    mu = F.sum(F.col("_n") * F.col("_m")) / total
    between = F.sum(F.col("_n") * F.col("_m") * F.col("_m")) - total * mu * mu
    var = (F.when(total == 0, F.raise_error(F.lit("an empty mask has no mean")).cast("double"))
           .when(total == 1, F.raise_error(F.lit("one masked token has no variance")).cast("double"))
           .otherwise((F.sum("_s") + F.greatest(between, F.lit(0.0))) / (total - 1)))
    stats = materialise(per_row.groupBy(by).agg(mu.alias("_mu"), var.alias("_var")), "whiten_stats")
    # one row per batch, broadcast if their number is bounded; token arrays then stay where they are
    res = df.join(bounded_broadcast(stats), by)
    res = res.withColumn(out, F.transform(col, lambda x: (x - F.col("_mu")) / F.sqrt(F.col("_var") + 1e-8)))
    return res.drop("_mu", "_var")


def compute_gae(df: DataFrame, gamma: float = 1.0, lam: float = 1.0, mask_col: str = "attention_mask",
                rewards_col: str = "token_level_rewards", values_col: str = "values",
                by: str = "batch_id") -> DataFrame:
    """M10 + M11: GAE advantages whitened over the batch (mask = attention mask,
    as the reference does; pass ``mask_col='info_mask'`` to exclude retrieved
    tokens), returns = advantages + values before whitening."""
    g = rl.gae(rewards_col, values_col, gamma, lam)
    # written once: the whitening reads it twice, and neither KL nor GAE is computed again
    df = materialise(df.withColumn("_g", g).withColumn("advantages", F.col("_g.advantages"))
                     .withColumn("returns", F.col("_g.returns")).drop("_g"), "gae")
    return masked_whiten(df, "advantages", mask_col, by=by)


def compute_grpo(df: DataFrame, group_col: str = "group_id", rewards_col: str = "token_level_rewards",
                 mask_col: str = "attention_mask", eps: float = 1e-6) -> DataFrame:
    """(score - group mean) / (group sample std + eps); a singleton group
    uses mean 0, std 1. Group statistics are a partial aggregate (a hot group
    never lands in one task) joined back by a size-checked broadcast."""
    score = F.aggregate(F.col(rewards_col), F.lit(0.0), lambda a, x: a + x)
    s = df.withColumn("_score", score)
    st = (s.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"), F.avg("_score").alias("_mu"),
                                   F.stddev_samp("_score").alias("_sd")))
    st = st.select(group_col,
                   F.when(F.col("_n") == 1, F.lit(0.0)).otherwise(F.col("_mu")).alias("_mu"),
                   F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.col("_sd")).alias("_sd"))
    # one row per group; AQE picks broadcast (or a skew-split shuffle join) at run time
    j = s.join(st, group_col)
    a = (F.col("_score") - F.col("_mu")) / (F.col("_sd") + eps)
    j = j.withColumn("grpo_score", a)
    j = j.withColumn("advantages", F.transform(mask_col, lambda m: F.col("grpo_score") * m))
    return j.withColumn("returns", F.col("advantages")).drop("_score", "_mu", "_sd")


def policy_loss_stats(df: DataFrame, cliprange: float = 0.2, by: str = "batch_id",
                      old_col: str = "old_log_probs", new_col: str = "log_probs",
                      adv_col: str = "advantages", mask_col: str = "attention_mask") -> DataFrame:
    """PPO clipped loss, clip fraction and approx KL as masked means over
    the batch (sums of per-row HOF reductions, then a partial aggregate)."""
    z = F.arrays_zip(F.col(old_col).alias("o"), F.col(new_col).alias("n"),
                     F.col(adv_col).alias("a"), F.col(mask_col).alias("m"))

    def per_row(fn):
        return F.aggregate(z, F.lit(0.0), lambda acc, e: acc + fn(e) * e["m"])

    def ratio(e):
        return F.exp(e["n"] - e["o"])

    def l1(e):
        return -e["a"] * ratio(e)

    def l2(e):
        return -e["a"] * F.least(F.greatest(ratio(e), F.lit(1 - cliprange)), F.lit(1 + cliprange))

    return (df.groupBy(by).agg(
        F.sum(per_row(lambda e: F.greatest(l1(e), l2(e)))).alias("_pg"),
        F.sum(per_row(lambda e: F.when(l2(e) > l1(e), 1.0).otherwise(0.0))).alias("_cf"),
        F.sum(per_row(lambda e: -(e["n"] - e["o"]))).alias("_kl"),
        F.sum(rl.array_sum(mask_col)).alias("_m"))
        .select(by, (F.col("_pg") / F.col("_m")).alias("pg_loss"),
                (F.col("_cf") / F.col("_m")).alias("pg_clipfrac"),
                (F.col("_kl") / F.col("_m")).alias("ppo_kl")))


def value_loss_stats(df: DataFrame, cliprange_value: float = 0.5, by: str = "batch_id",
                     vpred_col: str = "vpreds", returns_col: str = "returns",
                     values_col: str = "values", mask_col: str = "attention_mask") -> DataFrame:
    """0.5 * masked mean of max(unclipped, clipped) squared error and the
    clip fraction, over the batch."""
    z = F.arrays_zip(F.col(vpred_col).alias("p"), F.col(returns_col).alias("r"),
                     F.col(values_col).alias("v"), F.col(mask_col).alias("m"))

    def clipped(e):
        return F.least(F.greatest(e["p"], e["v"] - cliprange_value), e["v"] + cliprange_value)

    def l1(e):
        return (e["p"] - e["r"]) * (e["p"] - e["r"])

    def l2(e):
        return (clipped(e) - e["r"]) * (clipped(e) - e["r"])

    def per_row(fn):
        return F.aggregate(z, F.lit(0.0), lambda acc, e: acc + fn(e) * e["m"])

    return (df.groupBy(by).agg(
        F.sum(per_row(lambda e: F.greatest(l1(e), l2(e)))).alias("_vl"),
        F.sum(per_row(lambda e: F.when(l2(e) > l1(e), 1.0).otherwise(0.0))).alias("_cf"),
        F.sum(rl.array_sum(mask_col)).alias("_m"))
        .select(by, (0.5 * F.col("_vl") / F.col("_m")).alias("vf_loss"),
                (F.col("_cf") / F.col("_m")).alias("vf_clipfrac")))


def data_metrics(df: DataFrame, by: str = "batch_id", max_response_length: int | None = None,
                 use_critic: bool = True, prompt_len: Column | None = None,
                 max_prompt_length: int | None = None) -> DataFrame:
    """score/reward/advantage/return/value statistics, explained variance
    and prompt- and response-length statistics per batch, as a long (batch, metric,
    value) table. Token-level statistics are over valid (mask = 1) tokens only;
    variances merge the rows' centred squares."""
    m = "attention_mask"
    seq_score = rl.array_sum("token_level_scores")
    seq_reward = rl.array_sum("token_level_rewards")
    resp_len = rl.array_sum(m)

    def valid(col):
        return F.filter(F.arrays_zip(F.col(col).alias("x"), F.col(m).alias("m")), lambda e: e["m"] == 1)

    def vsum(col, f=lambda x: x):
        return F.aggregate(valid(col), F.lit(0.0), lambda a, e: a + f(e["x"]))

    def vmax(col):
        return F.array_max(F.transform(valid(col), lambda e: e["x"].cast("double")))

    def vmin(col):
        return F.array_min(F.transform(valid(col), lambda e: e["x"].cast("double")))

    aggs = [F.avg(seq_score).alias("critic/score/mean"), F.max(seq_score).alias("critic/score/max"),
            F.min(seq_score).alias("critic/score/min"),
            F.avg(seq_reward).alias("critic/rewards/mean"), F.max(seq_reward).alias("critic/rewards/max"),
            F.min(seq_reward).alias("critic/rewards/min"),
            (F.sum(vsum("advantages")) / F.sum(resp_len)).alias("critic/advantages/mean"),
            F.max(vmax("advantages")).alias("critic/advantages/max"),
            F.min(vmin("advantages")).alias("critic/advantages/min"),
            (F.sum(vsum("returns")) / F.sum(resp_len)).alias("critic/returns/mean"),
            F.max(vmax("returns")).alias("critic/returns/max"),
            F.min(vmin("returns")).alias("critic/returns/min"),
            F.avg(resp_len).alias("response_length/mean"), F.max(resp_len).alias("response_length/max"),
            F.min(resp_len).alias("response_length/min")]
    if max_response_length is not None:
        aggs.append(F.avg(F.when(resp_len == max_response_length, 1.0).otherwise(0.0))
                    .alias("response_length/clip_ratio"))
    if prompt_len is not None:
        aggs += [F.avg(prompt_len).alias("prompt_length/mean"), F.max(prompt_len).alias("prompt_length/max"),
                 F.min(prompt_len).alias("prompt_length/min")]
        if max_prompt_length is not None:
            aggs.append(F.avg(F.when(prompt_len == max_prompt_length, 1.0).otherwise(0.0)).alias("prompt_length/clip_ratio"))
    if use_critic:
        diff = F.zip_with("returns", "values", lambda r, v: r - v)

        def variance(col) -> Column:
            """Sample variance over the batch's valid tokens, from each row's count, mean and centred squares."""
            mu = F.when(resp_len > 0, rl.masked_mean(col, m)).otherwise(0.0)
            ss = F.when(resp_len > 0, rl.masked_var(col, m, unbiased=False) * resp_len).otherwise(0.0)
            n, s1 = F.sum(resp_len), F.sum(resp_len * mu)
            return (F.sum(ss) + F.greatest(F.sum(resp_len * mu * mu) - s1 * s1 / n, F.lit(0.0))) / (n - 1)

        aggs += [(F.sum(vsum("values")) / F.sum(resp_len)).alias("critic/values/mean"),
                 F.max(vmax("values")).alias("critic/values/max"),
                 F.min(vmin("values")).alias("critic/values/min"),
                 (1.0 - variance(diff) / (variance("returns") + 1e-5)).alias("critic/vf_explained_var")]
    wide = df.groupBy(by).agg(*aggs)
    names = [c for c in wide.columns if c != by]
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value"))
                                for c in names]))
    return wide.select(by, stack.alias("_m")).select(by, "_m.metric", "_m.value")


def reduce_metrics(metrics: DataFrame, name_col: str = "metric", value_col: str = "value") -> DataFrame:
    """Mean of each appended metric."""
    return metrics.groupBy(name_col).agg(F.avg(value_col).alias(value_col))


def length_stats(df: DataFrame, prompt_len: Column, response_len: Column) -> DataFrame:
    """Dataset rows and prompt/response token statistics."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.avg(prompt_len).alias("prompt_tokens_mean"), F.max(prompt_len).alias("prompt_tokens_max"),
                  F.avg(response_len).alias("response_tokens_mean"),
                  F.max(response_len).alias("response_tokens_max"))
