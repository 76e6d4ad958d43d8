"""Registered RL batch-maths queries over the ``token_rows`` fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlane.functions import rl
from searchlane.functions.text import token_count
from searchlane.operators import advantages as ADV
from searchlane.plans.registry import SQL_FX, register, sql_strip
from searchlane.sources import fixtures as fx
from searchlane.sources.tables import Tables

BETA = 0.001
GAMMA = 0.99
LAM = 0.95
R6 = 6


def _rows(spark, sf_dir):
    df = fx.token_rows(Tables(spark, sf_dir))
    return ADV.add_token_level_scores(df)


# token-level long view shared by the SQL oracles (t = 1-based position)
_SQL_TOK = f"""{SQL_FX['token_rows']},
tok AS (SELECT row_id, group_id, batch_id, score, t, len(responses) AS n,
               attention_mask[t] AS am, info_mask[t] AS im, old_log_probs[t] AS olp,
               ref_log_prob[t] AS rlp, "values"[t] AS v,
               CASE WHEN t = len(responses) THEN score ELSE 0.0 END AS tls
        FROM token_rows, generate_series(1, len(responses)) AS g(t))"""


@register("token_masks", sql=f"""
WITH {SQL_FX['token_rows']}
SELECT row_id, len(responses)::BIGINT AS n_tokens,
       (CASE WHEN coalesce(list_position(info_mask, 0), 0) = 0 THEN len(info_mask)
             ELSE list_position(info_mask, 0) END)::BIGINT AS eos_len,
       (list_sum(attention_mask) - 1)::BIGINT AS last_position,
       list_sum(info_mask)::BIGINT AS loss_tokens,
       round(list_sum(info_mask) / len(info_mask), 6) AS loss_coverage,
       len(list_filter(responses, lambda x: x <> 0))::BIGINT AS n_nonpad
FROM token_rows""")
def q_token_masks(spark, sf_dir):
    """M1, M2, M4, M5: EOS mask (first 0 of info_mask as EOS), positions,
    loss mask totals and coverage."""
    d = _rows(spark, sf_dir)
    em = rl.eos_mask("info_mask", 0)
    pos = rl.position_ids("attention_mask")
    loss = F.aggregate("info_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("row_id", F.size("responses").cast("long").alias("n_tokens"),
                    F.aggregate(em, F.lit(0).cast("long"), lambda a, x: a + x).alias("eos_len"),
                    F.element_at(pos, -1).cast("long").alias("last_position"),
                    loss.alias("loss_tokens"),
                    F.round(loss / F.size("info_mask"), R6).alias("loss_coverage"),
                    F.size(rl.concat_drop_pad(["responses"], 0)).cast("long").alias("n_nonpad"))


@register("kl_rewards", sql=f"""
WITH {_SQL_TOK}
SELECT row_id,
  round(sum(tls - {BETA}::DOUBLE * (olp - rlp) * im), 6) AS reward_sum,
  round(sum((olp - rlp) * im) / sum(im), 6) AS seq_kl,
  round(sum(abs(olp - rlp)), 6) AS kl_abs,
  round(sum(0.5::DOUBLE * (olp - rlp) * (olp - rlp)), 6) AS kl_mse,
  round(sum(least(greatest(exp(rlp - olp) - (rlp - olp) - 1, -10.0), 10.0)), 6) AS kl_low_var
FROM tok GROUP BY row_id""")
def q_kl_rewards(spark, sf_dir):
    """Token rewards = scores - beta * KL * info_mask."""
    d = ADV.apply_kl_penalty(_rows(spark, sf_dir), BETA)
    return d.select(
        "row_id", F.round(rl.array_sum("token_level_rewards"), R6).alias("reward_sum"),
        F.round("seq_kl", R6).alias("seq_kl"),
        F.round(rl.array_sum(rl.kl_penalty("old_log_probs", "ref_log_prob", "abs")), R6).alias("kl_abs"),
        F.round(rl.array_sum(rl.kl_penalty("old_log_probs", "ref_log_prob", "mse")), R6).alias("kl_mse"),
        F.round(rl.array_sum(rl.kl_penalty("old_log_probs", "ref_log_prob", "low_var_kl")), R6)
        .alias("kl_low_var"))


_SQL_GAE = f"""{_SQL_TOK},
r AS (SELECT *, tls - {BETA}::DOUBLE * (olp - rlp) * im AS rw,
             coalesce(lead(v) OVER (PARTITION BY row_id ORDER BY t), 0.0) AS nv FROM tok),
d AS (SELECT *, rw + {GAMMA}::DOUBLE * nv - v AS delta FROM r),
a AS (SELECT x.row_id, x.batch_id, x.t, x.v, x.am,
             sum(y.delta * pow({GAMMA * LAM}::DOUBLE, y.t - x.t)) AS adv
      FROM d x JOIN d y ON y.row_id = x.row_id AND y.t >= x.t
      GROUP BY x.row_id, x.batch_id, x.t, x.v, x.am),
bs AS (SELECT batch_id, sum(adv * am) / sum(am) AS mu, sum(am) AS n FROM a GROUP BY batch_id),
bv AS (SELECT a.batch_id, sum((adv - mu) * (adv - mu) * am) / bs.n * (bs.n / (bs.n - 1.0)) AS var, bs.mu
       FROM a JOIN bs ON bs.batch_id = a.batch_id GROUP BY a.batch_id, bs.n, bs.mu),
w AS (SELECT a.*, (adv - bv.mu) / sqrt(bv.var + 1e-8) AS wadv, adv + v AS ret
      FROM a JOIN bv ON bv.batch_id = a.batch_id)"""


@register("gae_advantages", sql=f"""
WITH {_SQL_GAE}
SELECT row_id, round(sum(wadv), 6) AS adv_sum, round(sum(CASE WHEN t = 1 THEN wadv END), 6) AS adv_first,
       round(sum(ret), 6) AS ret_sum
FROM w GROUP BY row_id""")
def q_gae_advantages(spark, sf_dir):
    """GAE(gamma=0.99, lambda=0.95) whitened over each batch."""
    d = ADV.apply_kl_penalty(_rows(spark, sf_dir), BETA)
    d = ADV.compute_gae(d, GAMMA, LAM)
    return d.select("row_id", F.round(rl.array_sum("advantages"), R6).alias("adv_sum"),
                    F.round(F.element_at("advantages", 1), R6).alias("adv_first"),
                    F.round(rl.array_sum("returns"), R6).alias("ret_sum"))


_SQL_GRPO = f"""{SQL_FX['token_rows']},
gs AS (SELECT group_id, count(*) AS n, avg(score) AS mu, stddev_samp(score) AS sd FROM token_rows GROUP BY group_id),
gr AS (SELECT t.*, (t.score - CASE WHEN gs.n = 1 THEN 0.0 ELSE gs.mu END)
                   / (CASE WHEN gs.n = 1 THEN 1.0 ELSE gs.sd END + 1e-6) AS grpo_score
       FROM token_rows t JOIN gs ON gs.group_id = t.group_id)"""


@register("grpo_advantages", sql=f"""
WITH {_SQL_GRPO}
SELECT row_id, group_id, round(grpo_score, 6) AS grpo_score,
       round(grpo_score * list_sum(attention_mask), 6) AS adv_sum FROM gr""")
def q_grpo_advantages(spark, sf_dir):
    """Outcome advantage normalised within each customer group."""
    d = ADV.compute_grpo(_rows(spark, sf_dir).withColumn("token_level_rewards", F.col("token_level_scores")))
    return d.select("row_id", "group_id", F.round("grpo_score", R6).alias("grpo_score"),
                    F.round(rl.array_sum("advantages"), R6).alias("adv_sum"))


@register("policy_loss", sql=f"""
WITH {_SQL_GRPO},
tk AS (SELECT gr.batch_id, gr.grpo_score * attention_mask[t] AS adv, old_log_probs[t] AS o,
              ref_log_prob[t] AS nl, attention_mask[t] AS m
       FROM gr, generate_series(1, len(responses)) AS g(t)),
l AS (SELECT *, -adv * exp(nl - o) AS l1, -adv * least(greatest(exp(nl - o), 0.8), 1.2) AS l2 FROM tk)
SELECT batch_id, round(sum(greatest(l1, l2) * m) / sum(m), 6) AS pg_loss,
       round(sum(CASE WHEN l2 > l1 THEN 1.0 ELSE 0.0 END * m) / sum(m), 6) AS pg_clipfrac,
       round(sum(-(nl - o) * m) / sum(m), 6) AS ppo_kl
FROM l GROUP BY batch_id""")
def q_policy_loss(spark, sf_dir):
    """M13 diagnostics per batch: new policy = reference log-probs."""
    d = ADV.compute_grpo(_rows(spark, sf_dir).withColumn("token_level_rewards", F.col("token_level_scores")))
    d = d.withColumn("log_probs", F.col("ref_log_prob"))
    s = ADV.policy_loss_stats(d, 0.2)
    return s.select("batch_id", *[F.round(c, R6).alias(c) for c in ("pg_loss", "pg_clipfrac", "ppo_kl")])


@register("value_loss", sql=f"""
WITH {_SQL_TOK},
l AS (SELECT batch_id, am AS m, v * 1.5 AS p, v + tls AS r, v FROM tok),
c AS (SELECT *, least(greatest(p, v - 0.05), v + 0.05) AS pc FROM l)
SELECT batch_id, round(0.5 * sum(greatest((p - r) * (p - r), (pc - r) * (pc - r)) * m) / sum(m), 6) AS vf_loss,
       round(sum(CASE WHEN (pc - r) * (pc - r) > (p - r) * (p - r) THEN 1.0 ELSE 0.0 END * m) / sum(m), 6) AS vf_clipfrac
FROM c GROUP BY batch_id""")
def q_value_loss(spark, sf_dir):
    """M14 per batch: vpreds = 1.5 x values, returns = values + token scores."""
    d = _rows(spark, sf_dir)
    d = d.withColumn("vpreds", F.transform("values", lambda v: v * 1.5)) \
        .withColumn("returns", F.zip_with("values", "token_level_scores", lambda v, s: v + s))
    s = ADV.value_loss_stats(d, 0.05)
    return s.select("batch_id", F.round("vf_loss", R6).alias("vf_loss"),
                    F.round("vf_clipfrac", R6).alias("vf_clipfrac"))


@register("kl_coefficients", sql=f"""
WITH {_SQL_TOK},
rk AS (SELECT row_id, batch_id, sum((olp - rlp) * im) / sum(im) AS seq_kl FROM tok GROUP BY row_id, batch_id),
st AS (SELECT batch_id AS step, avg(seq_kl) AS kl, count(*) AS batch_size FROM rk GROUP BY batch_id),
m AS (SELECT *, ln(1.0 + least(greatest(kl / 0.05 - 1.0, -0.2), 0.2) * batch_size / 10000.0) AS lm FROM st)
SELECT step, round(kl, 6) AS kl,
       round(0.001 * exp(coalesce(sum(lm) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)), 9) AS kl_coef
FROM m""")
def q_kl_coefficients(spark, sf_dir):
    """M9: adaptive KL coefficient per step (steps = batches in id order)."""
    d = ADV.apply_kl_penalty(_rows(spark, sf_dir), BETA)
    steps = ADV.batch_kl(d).withColumnRenamed("batch_id", "step").withColumn("run_id", F.lit(0))
    c = ADV.adaptive_kl_coefficients(steps, 0.001, 0.05, 10000.0)
    return c.select("step", F.round("kl", R6).alias("kl"), F.round("kl_coef", 9).alias("kl_coef"))


@register("entropy_logprob", sql=f"""
WITH {SQL_FX['token_rows']},
x AS (SELECT row_id, "values" AS l, list_max("values") AS mx FROM token_rows)
SELECT row_id,
  round(mx + ln(list_sum(list_transform(l, lambda v: exp(v - mx))))
        - list_sum(list_transform(l, lambda v: exp(v - mx) * v)) / list_sum(list_transform(l, lambda v: exp(v - mx))), 6) AS entropy,
  round(l[1] - (mx + ln(list_sum(list_transform(l, lambda v: exp(v - mx))))), 6) AS logprob0
FROM x""")
def q_entropy_logprob(spark, sf_dir):
    """M15 with each row's value array read as logits."""
    d = fx.token_rows(Tables(spark, sf_dir))
    return d.select("row_id", F.round(rl.entropy_from_logits("values"), R6).alias("entropy"),
                    F.round(rl.logprob_of_label("values", F.lit(0)), R6).alias("logprob0"))


def _sql_ntok(x):
    s = sql_strip(x)
    return f"(CASE WHEN {s} = '' THEN 0 ELSE len(regexp_split_to_array({s}, '\\s+')) END)"


@register("length_stats", sql=f"""
WITH {SQL_FX['sequences']}
SELECT count(*)::BIGINT AS n_rows, round(avg({_sql_ntok('prompt')}), 6) AS prompt_tokens_mean,
       max({_sql_ntok('prompt')})::BIGINT AS prompt_tokens_max,
       round(avg({_sql_ntok('response')}), 6) AS response_tokens_mean,
       max({_sql_ntok('response')})::BIGINT AS response_tokens_max
FROM sequences""")
def q_length_stats(spark, sf_dir):
    """R18 on the sequence table with the whitespace tokenizer."""
    s = fx.sequences(Tables(spark, sf_dir))
    r = ADV.length_stats(s, token_count("prompt"), token_count("response"))
    return r.select(F.col("n_rows").cast("long"), F.round("prompt_tokens_mean", R6).alias("prompt_tokens_mean"),
                    F.col("prompt_tokens_max").cast("long"),
                    F.round("response_tokens_mean", R6).alias("response_tokens_mean"),
                    F.col("response_tokens_max").cast("long"))


_SECTIONS = ("gen", "ref", "values", "adv", "update_critic", "update_actor", "rollout", "step")


@register("timing_metrics", sql=f"""
WITH {SQL_FX['token_rows']},
tk AS (SELECT sum(len(responses)) AS response, sum(len(responses) + group_id % 7) AS overall FROM token_rows),
sec AS (SELECT (["{'", "'.join(_SECTIONS)}"])[user_id % {len(_SECTIONS)} + 1] AS section, sum(value) AS seconds
        FROM events GROUP BY 1)
SELECT section, round(seconds, 6) AS seconds,
       round(seconds * 1000.0 / CASE WHEN section = 'gen' THEN response WHEN section <> 'step' THEN overall END, 6) AS per_token_ms
FROM sec, tk""".replace('["', "['").replace('"]', "']").replace('", "', "', '"))
def q_timing_metrics(spark, sf_dir):
    """Event values as section timings; generation per response token, the other
    timed sections per prompt plus response token, an untimed section without a rate."""
    from searchlane.operators.metrics import timing_metrics
    t = Tables(spark, sf_dir)
    names = F.array(*map(F.lit, _SECTIONS))
    section = F.element_at(names, (F.col("user_id") % len(_SECTIONS) + 1).cast("int"))
    timings = t.events.groupBy(section.alias("section")).agg(F.sum("value").alias("seconds"))
    rows = fx.token_rows(t).withColumn("n_prompt", F.col("group_id") % 7)
    r = timing_metrics(rows, timings, prompt_col="n_prompt")
    return r.select("section", F.round("seconds", R6).alias("seconds"),
                    F.round("per_token_ms", R6).alias("per_token_ms"))


def _gae_frame(spark, sf_dir):
    d = ADV.apply_kl_penalty(_rows(spark, sf_dir), BETA)
    return ADV.compute_gae(d, GAMMA, LAM)


_SQL_METRICS = f"""{_SQL_GAE},
rw AS (SELECT row_id, batch_id, max(score) AS seq_score,
              sum(tls - {BETA}::DOUBLE * (olp - rlp) * im) AS seq_reward, count(*) AS n_tok
       FROM r GROUP BY row_id, batch_id),
tokm AS (SELECT batch_id, avg(wadv) AS adv_mean, max(wadv) AS adv_max, min(wadv) AS adv_min,
                avg(ret) AS ret_mean, max(ret) AS ret_max, min(ret) AS ret_min,
                avg(v) AS val_mean, max(v) AS val_max, min(v) AS val_min,
                1.0 - var_samp(ret - v) / (var_samp(ret) + 1e-5) AS ev
         FROM w GROUP BY batch_id),
rowm AS (SELECT batch_id, avg(seq_score) AS s_mean, max(seq_score) AS s_max, min(seq_score) AS s_min,
                avg(seq_reward) AS r_mean, max(seq_reward) AS r_max, min(seq_reward) AS r_min,
                avg(n_tok) AS l_mean, max(n_tok)::DOUBLE AS l_max, min(n_tok)::DOUBLE AS l_min,
                avg(CASE WHEN n_tok = 7 THEN 1.0 ELSE 0.0 END) AS l_clip
         FROM rw GROUP BY batch_id),
wide AS (SELECT * FROM rowm JOIN tokm USING (batch_id)),
long AS (
  SELECT batch_id, metric, value FROM wide
  UNPIVOT (value FOR metric IN (
    s_mean AS 'critic/score/mean', s_max AS 'critic/score/max', s_min AS 'critic/score/min',
    r_mean AS 'critic/rewards/mean', r_max AS 'critic/rewards/max', r_min AS 'critic/rewards/min',
    adv_mean AS 'critic/advantages/mean', adv_max AS 'critic/advantages/max', adv_min AS 'critic/advantages/min',
    ret_mean AS 'critic/returns/mean', ret_max AS 'critic/returns/max', ret_min AS 'critic/returns/min',
    l_mean AS 'response_length/mean', l_max AS 'response_length/max', l_min AS 'response_length/min',
    l_clip AS 'response_length/clip_ratio',
    val_mean AS 'critic/values/mean', val_max AS 'critic/values/max', val_min AS 'critic/values/min',
    ev AS 'critic/vf_explained_var')))"""


@register("data_metrics", sql=f"""
WITH {_SQL_METRICS}
SELECT batch_id, metric, round(value, 6) AS value FROM long""")
def q_data_metrics(spark, sf_dir):
    """R14 per batch as (batch_id, metric, value)."""
    m = ADV.data_metrics(_gae_frame(spark, sf_dir), max_response_length=7)
    return m.select("batch_id", "metric", F.round("value", R6).alias("value"))


@register("prompt_length_metrics", sql=f"""
WITH {SQL_FX['token_rows']},
p AS (SELECT batch_id, (row_id % 11 + 1)::DOUBLE AS n FROM token_rows),
w AS (SELECT batch_id, avg(n) AS m, max(n) AS hi, min(n) AS lo, avg(CASE WHEN n = 11 THEN 1.0 ELSE 0.0 END)::DOUBLE AS clip
      FROM p GROUP BY batch_id),
l AS (SELECT batch_id, metric, value FROM w UNPIVOT (value FOR metric IN (
        m AS 'prompt_length/mean', hi AS 'prompt_length/max', lo AS 'prompt_length/min', clip AS 'prompt_length/clip_ratio')))
SELECT batch_id, metric, round(value, 6) AS value FROM l""")
def q_prompt_length_metrics(spark, sf_dir):
    """R14 with prompt lengths (of 1 to 11 tokens by row): their statistics and the share at the cap."""
    m = ADV.data_metrics(_gae_frame(spark, sf_dir), use_critic=False, prompt_len=(F.col("row_id") % 11 + 1).cast("double"),
                         max_prompt_length=11)
    return m.where(F.col("metric").startswith("prompt_length/")).select("batch_id", "metric", F.round("value", R6).alias("value"))


@register("reduce_metrics", sql=f"""
WITH {_SQL_METRICS}
SELECT metric, round(avg(value), 6) AS value FROM long GROUP BY metric""")
def q_reduce_metrics(spark, sf_dir):
    """Batch metrics mean-reduced per name."""
    m = ADV.reduce_metrics(ADV.data_metrics(_gae_frame(spark, sf_dir), max_response_length=7))
    return m.select("metric", F.round("value", R6).alias("value"))
