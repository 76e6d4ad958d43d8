"""Registered rollout / environment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlane.operators import rollouts as RO
from searchlane.operators.bm25 import bm25_search, build_bm25
from searchlane.operators.metrics import env_metrics
from searchlane.operators.observe import INVALID_ACTION_HINT
from searchlane.plans.registry import (SQL_BM25_HITS, SQL_CORPUS, SQL_FX, SQL_TEXT, SQL_TITLE,
                                       register, sql_lit, sql_strip)
from searchlane.plans.text_plans import _sql_parse
from searchlane.sources import fixtures as fx
from searchlane.sources.tables import Tables

MAX_OBS = 500
MAX_TURNS = 3

_a, _qs, _ans, _ = _sql_parse(False)
_aci, _, _, _ = _sql_parse(True)


def _sql_ntok(x):
    s = sql_strip(x)
    return f"(CASE WHEN {s} = '' THEN 0 ELSE len(regexp_split_to_array({s}, '\\s+')) END)"


def _sql_trunc(x, n):
    s = sql_strip(x)
    return (f"(CASE WHEN {_sql_ntok(x)} <= {n} THEN {s} ELSE "
            f"{sql_strip(f'array_to_string(regexp_split_to_array({s}, chr(92) || chr(115) || chr(43))[1:{n}], chr(32))')} END)")


_SQL_ENV = f"""{SQL_CORPUS}, {SQL_FX['responses']},
p AS (SELECT sample_id, turn_idx, response, {_a} AS action, {_qs} AS queries FROM responses),
req AS (SELECT sample_id, turn_idx, g.i - 1 AS qpos, queries[g.i] AS query
        FROM p, generate_series(1, len(queries)) AS g(i) WHERE action = 'search'),
q AS (SELECT DISTINCT query AS query_id, query FROM req),
{SQL_BM25_HITS.replace('{k}', '3')},
docs AS (SELECT h.query_id, h.rank, c.contents FROM hits h JOIN corpus c ON c.id = h.doc_id),
blk AS (SELECT query_id, string_agg('Doc ' || rank || '(Title: ' || {SQL_TITLE.format(c='contents')} || ') '
          || {SQL_TEXT.format(c='contents')} || chr(10), '' ORDER BY rank) AS result FROM docs GROUP BY query_id),
res AS (SELECT query_id AS query, {_sql_trunc('result', MAX_OBS)} AS result FROM blk),
pq AS (SELECT r.sample_id, r.turn_idx, r.qpos, r.query, coalesce(res.result, '') AS result
       FROM req r LEFT JOIN res ON res.query = r.query),
obs AS (SELECT sample_id, turn_idx,
          CASE WHEN count(*) = 1 THEN {sql_strip('min(result)')}
               ELSE {sql_strip("string_agg(" + sql_strip("'[Search ' || (qpos + 1) || '] Query: ' || query || chr(10) || " + sql_strip('result')) + ", chr(10) || chr(10) ORDER BY qpos)")} END AS observation
        FROM pq GROUP BY sample_id, turn_idx),
st AS (SELECT p.sample_id, p.turn_idx, p.response, p.action,
          CASE WHEN p.action = 'answer' THEN ''
               WHEN p.action = 'search' THEN chr(10) || chr(10) || '<information>' || coalesce(o.observation, '') || '</information>' || chr(10) || chr(10)
               ELSE {sql_lit(INVALID_ACTION_HINT)} END AS next_obs,
          CASE WHEN p.action = 'answer' THEN 1 ELSE 0 END AS done,
          CASE WHEN p.action IN ('answer', 'search') THEN 1 ELSE 0 END AS valid_action,
          CASE WHEN p.action = 'search' THEN 1 ELSE 0 END AS is_search
       FROM p LEFT JOIN obs o ON o.sample_id = p.sample_id AND o.turn_idx = p.turn_idx)"""


def _env(spark, sf_dir):
    t = Tables(spark, sf_dir)
    corpus = fx.corpus(t)
    idx = build_bm25(corpus)
    steps = fx.responses(t)
    return RO.env_step(steps, ["sample_id", "turn_idx"], retrieve_fn=lambda q: bm25_search(q, idx, 3),
                       corpus=corpus, max_obs_tokens=MAX_OBS, k=3)


@register("env_step", sql=f"""
WITH {_SQL_ENV}
SELECT sample_id, turn_idx, action, done, valid_action, is_search, md5(next_obs) AS next_obs_md5,
       length(next_obs)::BIGINT AS next_obs_chars FROM st""")
def q_env_step(spark, sf_dir):
    """A4 + A2 + A3 + J4 + V11 dedupe: one environment step for every agent
    response: parse, deduplicated BM25 top-3 per query, 500-token cap,
    multi-query sections, information block / invalid hint."""
    e = _env(spark, sf_dir)
    return e.select("sample_id", "turn_idx", F.col("act.action").alias("action"),
                    "done", "valid_action", "is_search", F.md5("next_obs").alias("next_obs_md5"),
                    F.length("next_obs").cast("long").alias("next_obs_chars"))


_SQL_REPLAY = f"""{SQL_FX['responses']},
s AS (SELECT sample_id, (SELECT count(*) FROM conversations c2 WHERE c2.conv_id = r.sample_id
                                AND c2.role = 'assistant' AND c2.turn < r.turn_idx) AS step, {_a} AS action
      FROM responses r),
s2 AS (SELECT * FROM s WHERE step <= {MAX_TURNS}),
g AS (SELECT sample_id, min(CASE WHEN action = 'answer' THEN step END) AS answer_step FROM s2 GROUP BY sample_id),
rp AS (SELECT s2.sample_id, (1 + least(coalesce(g.answer_step, {MAX_TURNS}), {MAX_TURNS}))::BIGINT AS turns,
          sum(CASE WHEN step <= coalesce(g.answer_step, {MAX_TURNS}) AND action IN ('answer', 'search') THEN 1 ELSE 0 END)::BIGINT AS valid_actions,
          sum(CASE WHEN step <= coalesce(g.answer_step, {MAX_TURNS}) AND action = 'search' THEN 1 ELSE 0 END)::BIGINT AS valid_searches,
          g.answer_step IS NULL AS active
       FROM s2 JOIN g ON g.sample_id = s2.sample_id GROUP BY s2.sample_id, g.answer_step)"""


@register("replay_rollouts", sql=f"""
WITH {_SQL_REPLAY}
SELECT sample_id, turns, valid_actions, valid_searches, active,
       CASE WHEN active THEN 'failed' ELSE 'completed' END AS collector_status FROM rp""")
def q_replay(spark, sf_dir):
    """A6 + A7: replay of up to 3 turns + final turn per conversation."""
    r = RO.replay_rollouts(fx.responses(Tables(spark, sf_dir)), MAX_TURNS)
    return RO.collect_status(r).select("sample_id", "turns", "valid_actions", "valid_searches",
                                       "active", "collector_status")


@register("failed_rollouts", sql=f"""
WITH {_SQL_REPLAY}
SELECT sample_id, CASE WHEN active OR sample_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS collector_status,
       CASE WHEN sample_id % 5 = 0 THEN 'model failed' END AS error FROM rp""")
def q_failed_rollouts(spark, sf_dir):
    """Per-sample errors joined to the replay's status; an error fails a sample that answered."""
    r = RO.replay_rollouts(fx.responses(Tables(spark, sf_dir)), MAX_TURNS)
    errors = r.where("sample_id % 5 = 0").select("sample_id", F.lit("model failed").alias("error"))
    return RO.collect_status(r, errors).select("sample_id", "collector_status", "error")


@register("env_metrics", sql=f"""
WITH {_SQL_REPLAY}
SELECT round(avg(turns), 6) AS actions_mean, max(turns)::DOUBLE AS actions_max, min(turns)::DOUBLE AS actions_min,
       round(1.0 - avg(CASE WHEN active THEN 1.0 ELSE 0.0 END), 6) AS finish_ratio,
       round(avg(valid_actions), 6) AS valid_action_mean,
       round(avg(valid_actions / turns), 6) AS valid_action_ratio,
       round(avg(valid_searches), 6) AS valid_search_mean
FROM rp""")
def q_env_metrics(spark, sf_dir):
    """R15 over the replayed rollouts."""
    m = env_metrics(RO.replay_rollouts(fx.responses(Tables(spark, sf_dir)), MAX_TURNS))
    names = {"env/number_of_actions/mean": "actions_mean", "env/number_of_actions/max": "actions_max",
             "env/number_of_actions/min": "actions_min", "env/finish_ratio": "finish_ratio",
             "env/number_of_valid_action": "valid_action_mean",
             "env/ratio_of_valid_action": "valid_action_ratio",
             "env/number_of_valid_search": "valid_search_mean"}
    return m.select(*[(F.col(f"`{k}`") if "max" in k or "min" in k else F.round(F.col(f"`{k}`"), 6)).alias(v)
                      for k, v in names.items()])


@register("turn_stats", sql=f"""
WITH {SQL_FX['responses']}
SELECT sample_id, count(*)::BIGINT AS assistant_turns,
       sum(CASE WHEN {_aci} = 'search' THEN 1 ELSE 0 END)::BIGINT AS search_turn_count,
       sum(CASE WHEN {_aci} IS NULL THEN 1 ELSE 0 END)::BIGINT AS invalid_action_count
FROM responses GROUP BY sample_id""")
def q_turn_stats(spark, sf_dir):
    """Collector turn counters per sample (case-insensitive parser)."""
    return RO.turn_stats(fx.responses(Tables(spark, sf_dir)))


_SQL_MSG = f"""{_SQL_ENV},
m AS (SELECT sample_id, turn_idx, 0 AS sub, 'assistant' AS role, response AS content FROM st
      UNION ALL
      SELECT sample_id, turn_idx, 1, 'user',
             CASE WHEN {_aci.replace('response', 'st.response')} = 'search' THEN next_obs
                  ELSE chr(10) || {sql_lit(INVALID_ACTION_HINT.strip())} || chr(10) END
      FROM st WHERE {_aci.replace('response', 'st.response')} IS NULL OR {_aci.replace('response', 'st.response')} = 'search'),
msgs AS (SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY turn_idx, sub) - 1)::BIGINT AS msg_idx,
                role, content FROM m)"""


def _messages(spark, sf_dir):
    e = _env(spark, sf_dir)
    return RO.build_messages(e)


@register("build_messages", sql=f"""
WITH {_SQL_MSG}
SELECT sample_id, msg_idx, role, md5(content) AS content_md5 FROM msgs""")
def q_build_messages(spark, sf_dir):
    """Assistant / information / invalid-hint message table."""
    return _messages(spark, sf_dir).select("sample_id", "msg_idx", "role",
                                           F.md5("content").alias("content_md5"))


BUDGET = 120


@register("truncate_messages", sql=f"""
WITH c AS (SELECT conv_id, turn, text, {_sql_ntok('text')} AS n FROM conversations),
s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suf,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS newest FROM c),
k AS (SELECT * FROM s WHERE suf <= {BUDGET} OR newest)
SELECT conv_id, turn,
       md5(CASE WHEN suf <= {BUDGET} THEN text ELSE array_to_string(
            regexp_split_to_array({sql_strip('text')}, '\\s+')[n - {BUDGET} + 1:], ' ') END) AS content_md5,
       least(n, {BUDGET})::BIGINT AS token_len
FROM k""")
def q_truncate_messages(spark, sf_dir):
    """A9 over conversations: whole oldest messages go until 120 tokens hold the rest; a
    last message that is too long alone keeps its fitting suffix."""
    c = Tables(spark, sf_dir).conversations
    r = RO.truncate_messages(c, BUDGET, sample="conv_id", order="turn", content="text")
    return r.select("conv_id", "turn", F.md5("text").alias("content_md5"), "token_len")


@register("observation_diff", sql=f"""
WITH {_SQL_MSG},
ex AS (SELECT sample_id, turn_idx, next_obs AS expected FROM st WHERE action = 'search'),
ac AS (SELECT sample_id, turn_idx, content AS actual FROM m WHERE role = 'user' AND content LIKE '%<information>%')
SELECT coalesce(ex.sample_id, ac.sample_id) AS sample_id, coalesce(ex.turn_idx, ac.turn_idx) AS turn_idx,
       CASE WHEN ex.expected IS NULL THEN 'missing_expected' WHEN ac.actual IS NULL THEN 'missing_actual'
            WHEN {sql_strip('ex.expected')} = {sql_strip('ac.actual')} THEN 'match' ELSE 'mismatch' END AS status
FROM ex FULL OUTER JOIN ac ON ex.sample_id = ac.sample_id AND ex.turn_idx = ac.turn_idx""")
def q_observation_diff(spark, sf_dir):
    """Retrieval turns (training parser) vs information messages
    (collector parser, case-insensitive) on (sample, turn)."""
    e = _env(spark, sf_dir)
    ex = e.filter(F.col("act.action") == "search").select("sample_id", "turn_idx", F.col("next_obs").alias("expected"))
    a = parse = RO.parse_action("response", True)["action"]  # noqa: F841
    ac = (e.filter(parse == "search")
          .select("sample_id", "turn_idx", F.col("next_obs").alias("actual")))
    d = RO.observation_diff(ex, ac, ["sample_id", "turn_idx"])
    return d.select("sample_id", "turn_idx", "status")


@register("gather_samples", sql="""
SELECT conv_id, count(*)::BIGINT AS n_samples,
       md5(string_agg(text, chr(30) ORDER BY turn)) AS responses_md5
FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def q_gather_samples(spark, sf_dir):
    """Assistant turns of a conversation as the n samples of its prompt."""
    c = Tables(spark, sf_dir).conversations.filter(F.col("role") == "assistant")
    g = RO.gather_samples(c, "conv_id", "turn", "text")
    return g.select("conv_id", F.size("responses").cast("long").alias("n_samples"),
                    F.md5(F.array_join("responses", "\u001e")).alias("responses_md5"))


@register("resume_pending", sql=f"""
WITH {SQL_FX['sequences']}, {SQL_FX['rollout_log']},
k AS (SELECT *, CASE WHEN uid IS NOT NULL AND trim(uid) <> '' AND lower(trim(uid)) NOT IN ('none', 'nan') THEN 'uid:' || trim(uid)
                     ELSE 'index:' || "index" END AS sample_key FROM rollout_log),
done AS (SELECT DISTINCT sample_key FROM k WHERE score = 1.0)
SELECT split, "index", sample_key FROM k WHERE sample_key NOT IN (SELECT sample_key FROM done)""")
def q_resume_pending(spark, sf_dir):
    """J3 + sample keys: rollouts still to run after the correct ones are done."""
    log = fx.rollout_log(Tables(spark, sf_dir)).withColumn("sample_key", RO.sample_key())
    done = log.filter(F.col("score") == 1.0)
    return RO.resume_pending(log, done).select("split", "index", "sample_key")


@register("zip_batches", sql=f"""
WITH {SQL_FX['token_rows']}
SELECT row_id, batch_id, len(responses)::BIGINT AS n_tokens, round(score, 6) AS score FROM token_rows""")
def q_zip_batches(spark, sf_dir):
    """Two projections of the same batch zipped back by row id (shared
    column checked equal)."""
    tr = fx.token_rows(Tables(spark, sf_dir))
    a = tr.select("row_id", "batch_id", F.size("responses").cast("long").alias("n_tokens"))
    b = tr.select("row_id", "batch_id", F.round("score", 6).alias("score"))
    return RO.zip_batches(a, b)


PREF_LEN = 64


@register("preference_pairs", sql=f"""
WITH c AS (SELECT conv_id, turn, role, text,
                  lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_text,
                  lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role
           FROM conversations),
a AS (SELECT conv_id, turn, text AS chosen, CASE WHEN prev_role = 'user' THEN prev_text ELSE '' END AS prompt,
             lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS rejected
      FROM c WHERE role = 'assistant')
SELECT conv_id, turn,
       least({_sql_ntok('prompt')} + {_sql_ntok('chosen')} + 1, {PREF_LEN})::BIGINT AS chosen_len,
       least({_sql_ntok('prompt')} + {_sql_ntok('rejected')} + 1, {PREF_LEN})::BIGINT AS rejected_len
FROM a WHERE rejected IS NOT NULL""")
def q_preference_pairs(spark, sf_dir):
    """Each assistant turn paired with the next assistant turn of the same
    conversation (consecutive pairs: linear, never all pairs), prompt = the
    user turn just before; 64-token right-padded sequences."""
    from pyspark.sql import Window
    c = Tables(spark, sf_dir).conversations
    w = Window.partitionBy("conv_id").orderBy("turn")
    prev = c.withColumn("prev_text", F.lag("text").over(w)).withColumn("prev_role", F.lag("role").over(w))
    a = prev.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("chosen"),
        F.when(F.col("prev_role") == "user", F.col("prev_text")).otherwise(F.lit("")).alias("prompt"))
    a = a.withColumn("rejected", F.lead("chosen").over(w)).filter(F.col("rejected").isNotNull())
    p = RO.preference_pairs(a, PREF_LEN)
    s = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    return p.select("conv_id", "turn", s("chosen_mask").alias("chosen_len"), s("rejected_mask").alias("rejected_len"))


@register("distinct_queries", sql=f"""
WITH {SQL_FX['responses']},
p AS (SELECT sample_id, turn_idx, {_qs} AS queries, {_a} AS action FROM responses),
req AS (SELECT sample_id, turn_idx, g.i - 1 AS qpos, queries[g.i] AS query
        FROM p, generate_series(1, len(queries)) AS g(i) WHERE action = 'search')
SELECT md5(query) AS query_md5, arg_min(sample_id, (sample_id, turn_idx, qpos)) AS first_sample,
       arg_min(turn_idx, (sample_id, turn_idx, qpos)) AS first_turn, count(*)::BIGINT AS n_requests
FROM req GROUP BY query""")
def q_distinct_queries(spark, sf_dir):
    """W13 + V11 dedupe: distinct search queries with first-seen position."""
    from searchlane.functions.actions import parse_action
    from searchlane.operators.retrieval_extras import distinct_first_seen
    r = fx.responses(Tables(spark, sf_dir)).withColumn("act", parse_action("response"))
    req = RO.search_requests(r, ["sample_id", "turn_idx"])
    d = distinct_first_seen(req, "query", ("sample_id", "turn_idx", "qpos"))
    return d.select(F.md5("query").alias("query_md5"), F.col("first_seen.sample_id").alias("first_sample"),
                    F.col("first_seen.turn_idx").alias("first_turn"), "n_requests")


@register("max_prompt_tokens", sql=f"""
WITH c AS (SELECT conv_id, sum({_sql_ntok('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
SELECT conv_id, max(n)::BIGINT AS max_prompt_tokens FROM c GROUP BY conv_id""")
def q_max_prompt_tokens(spark, sf_dir):
    """A10 + A13: largest length a growing conversation prompt reaches."""
    c = Tables(spark, sf_dir).conversations
    grown = RO.prompt_lengths(c, "conv_id", "turn", "text")
    return RO.max_prompt_tokens(grown, "cum_tokens", "conv_id")


_SQL_LOOP = f"""{_SQL_ENV},
s AS (SELECT *, count(*) OVER (PARTITION BY sample_id ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS step FROM st),
lim AS (SELECT sample_id, step, action, response, CASE WHEN step = {MAX_TURNS} THEN '' ELSE next_obs END AS obs,
               valid_action, is_search FROM s WHERE step <= {MAX_TURNS}),
ends AS (SELECT sample_id, min(CASE WHEN action = 'answer' THEN step END) AS ans, max(step) AS last_step
         FROM lim GROUP BY sample_id),
run AS (SELECT l.*, e.ans, coalesce(e.ans, least(e.last_step + 1, {MAX_TURNS})) AS last_call
        FROM lim l JOIN ends e USING (sample_id) WHERE l.step <= coalesce(e.ans, {MAX_TURNS}))"""


def _replayed(spark, sf_dir):
    """Corpus, its index, a model that replays each conversation's responses, and prompts."""
    from pyspark.sql import Window
    t = Tables(spark, sf_dir)
    corpus = fx.corpus(t)
    idx = build_bm25(corpus)
    by_turn = Window.partitionBy("sample_id").orderBy("turn_idx")
    known = fx.responses(t).select("sample_id", (F.row_number().over(by_turn) - 1).cast("long").alias("step"),
                                   F.col("response").alias("text"))

    def model(active):
        return active.join(known, ["sample_id", "step"], "left").withColumn(
            "error", F.when(F.col("text").isNull(), F.lit("no response")))

    prompts = known.select("sample_id").distinct().withColumn(
        "prompt_text", F.concat(F.lit("Question "), F.col("sample_id").cast("string"), F.lit(": ")))
    return corpus, idx, model, prompts


def _loop(spark, sf_dir):
    """The rollout loop over replayed responses."""
    corpus, idx, model, prompts = _replayed(spark, sf_dir)
    return RO.collect_rollouts(prompts, model, lambda q: bm25_search(q, idx, 3), corpus, MAX_TURNS, MAX_OBS)


@register("collect_rollouts", sql=f"""
WITH {_SQL_LOOP},
grown AS (SELECT sample_id, string_agg(response || obs, '' ORDER BY step) AS body FROM run WHERE step < last_call GROUP BY sample_id)
SELECT r.sample_id, CASE WHEN r.ans IS NULL THEN 'failed' ELSE 'completed' END AS collector_status,
       count(*)::BIGINT AS assistant_turns, sum(valid_action)::BIGINT AS valid_actions, sum(is_search)::BIGINT AS valid_searches,
       CASE WHEN r.ans IS NULL AND any_value(e.last_step) < {MAX_TURNS} THEN 'no response' END AS error,
       {_sql_ntok("('Question ' || r.sample_id || ': ' || coalesce(any_value(g.body), ''))")}::BIGINT AS max_prompt_tokens
FROM run r JOIN ends e USING (sample_id) LEFT JOIN grown g USING (sample_id) GROUP BY r.sample_id, r.ans""")
def q_collect_rollouts(spark, sf_dir):
    """A6 + A7 + A10 + J2 + V9: three turns with retrieval and a final one, checkpointed per
    turn; status, counters, errors and the largest prompt per sample."""
    return RO.rollout_samples(_loop(spark, sf_dir))


@register("resumed_rollouts", sql=f"""
WITH {SQL_FX['responses']},
s AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY turn_idx) - 1 AS step, {_aci} AS action FROM responses),
lim AS (SELECT * FROM s WHERE step <= {MAX_TURNS}),
ends AS (SELECT sample_id, min(CASE WHEN action = 'answer' THEN step END) AS ans, max(step) AS last_step
         FROM lim GROUP BY sample_id),
run AS (SELECT l.*, e.ans FROM lim l JOIN ends e USING (sample_id) WHERE l.step <= coalesce(e.ans, {MAX_TURNS}))
SELECT r.sample_id, CASE WHEN r.ans IS NULL THEN 'failed' ELSE 'completed' END AS collector_status,
       count(*)::BIGINT + CASE WHEN r.ans IS NULL AND any_value(e.last_step) < {MAX_TURNS} THEN 1 ELSE 0 END AS assistant_turns,
       count(*) FILTER (WHERE action = 'search' AND step < {MAX_TURNS})::BIGINT AS search_turns,
       count(*) FILTER (WHERE action IS NULL AND step < {MAX_TURNS})::BIGINT AS invalid_actions,
       CASE WHEN r.ans IS NOT NULL THEN NULL WHEN any_value(e.last_step) < {MAX_TURNS} THEN 'no response'
            ELSE 'Final answer generation did not return an <answer> block.' END AS collector_error
FROM run r JOIN ends e USING (sample_id) GROUP BY r.sample_id, r.ans""")
def q_resumed_rollouts(spark, sf_dir):
    """A7 + A11 + V11: a collector with a result cache is left after two steps, and a second one
    on the same folder continues from its published events."""
    from searchlane.operators.collector import Collector, collected
    from searchlane.operators.result_cache import ResultCache
    from searchlane.session import scratch_path
    corpus, idx, model, prompts = _replayed(spark, sf_dir)
    messages = prompts.select("sample_id", F.lit(0).alias("msg_idx"), F.lit("user").alias("role"),
                              F.col("prompt_text").alias("content"))
    folder = scratch_path(spark, "collector")
    cache = ResultCache(spark, f"{folder}/cache", 10_000)

    def collector():
        return Collector(folder, messages, model, lambda q: bm25_search(q, idx, 3).select("query_id", "rank", "doc_id", "score"),
                         corpus, MAX_TURNS, MAX_OBS, cache=cache)

    first = collector()
    for step in (0, 1):
        first.run_step(step)
    return collected(collector().run()).select("sample_id", "collector_status", "assistant_turns", "search_turns",
                                               "invalid_actions", "collector_error")


@register("info_masks", sql=f"""
WITH {_SQL_LOOP},
seg AS (SELECT sample_id, {_sql_ntok('response')} AS own, CASE WHEN obs = '' THEN 0 ELSE {_sql_ntok('obs')} END AS env, step FROM run)
SELECT sample_id, sum(own + env)::BIGINT AS n_tokens, sum(own)::BIGINT AS n_own,
       md5(string_agg(repeat('1', own::INT) || repeat('0', env::INT), '' ORDER BY step)) AS mask_md5
FROM seg GROUP BY sample_id""")
def q_info_masks(spark, sf_dir):
    """M4 + A13 + M5: information mask of every rollout's response and its loss mask."""
    from searchlane.functions import rl
    masks = RO.info_mask(RO.response_segments(_loop(spark, sf_dir)))
    ones = F.transform("info_mask", lambda x: F.lit(1))
    loss = rl.loss_mask(ones, "info_mask")
    return masks.select("sample_id", F.size("info_mask").cast("long").alias("n_tokens"),
                        F.aggregate(loss, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_own"),
                        F.md5(F.array_join("info_mask", "")).alias("mask_md5"))
