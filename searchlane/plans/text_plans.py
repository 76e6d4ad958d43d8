"""Registered text, action-parsing and reward-scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlane.functions import actions as A
from searchlane.functions import text as X
from searchlane.operators import rewards as R
from searchlane.plans.registry import (SQL_CORPUS, SQL_FX, SQL_TEXT, SQL_TITLE, register,
                                       sql_em, sql_extract_answer, sql_normalize_answer,
                                       sql_strip, sql_subem)
from searchlane.sources import fixtures as fx
from searchlane.sources.tables import Tables


def _t(spark, sf_dir):
    return Tables(spark, sf_dir)


# ----------------------------------------------------------------- T1
@register("normalize_answer", sql=f"""
SELECT conv_id, turn, {sql_normalize_answer('text')} AS normalized FROM conversations""")
def q_normalize_answer(spark, sf_dir):
    """T1 over every conversation text (Unicode word boundaries)."""
    c = _t(spark, sf_dir).conversations
    return c.select("conv_id", "turn", X.normalize_answer("text").alias("normalized"))


# ------------------------------------------------------- T2-T5, T18, V14
_PAIR = "'(Title: ' || regexp_replace(" + SQL_TITLE.format(c="contents") + \
    ", '^\"+|\"+$', '', 'g') || ') ' || " + SQL_TEXT.format(c="contents")


@register("passage_fields", sql=f"""
WITH {SQL_CORPUS}
SELECT id, {SQL_TITLE.format(c='contents')} AS title,
       regexp_replace({SQL_TITLE.format(c='contents')}, '^"+|"+$', '', 'g') AS title_unquoted,
       md5({SQL_TEXT.format(c='contents')}) AS text_md5,
       md5('"' || {SQL_TITLE.format(c='contents')} || '"' || chr(10) || {SQL_TEXT.format(c='contents')}) AS remade_md5,
       md5('passage: ' || contents) AS e5_input_md5,
       md5({_PAIR}) AS pair_md5,
       md5(regexp_replace({_PAIR}, '(?s)^\\(Title:\\s*([^)]+)\\)\\s*(.+)$', '"\\1"' || chr(10) || '\\2')) AS converted_md5
FROM corpus""")
def q_passage_fields(spark, sf_dir):
    """Title / text split, quote stripping, e5 input, pair text round trip."""
    c = fx.corpus(_t(spark, sf_dir))
    title = X.passage_title("contents")
    bare = X.passage_title("contents", strip_quotes=True)
    text = X.passage_text("contents")
    pair = X.pair_text(bare, text)
    return c.select(
        "id", title.alias("title"), bare.alias("title_unquoted"), F.md5(text).alias("text_md5"),
        F.md5(X.make_passage(title, text)).alias("remade_md5"),
        F.md5(X.encoder_input("contents", "e5-base-v2", is_query=False)).alias("e5_input_md5"),
        F.md5(pair).alias("pair_md5"),
        F.md5(X.convert_title_format(pair)).alias("converted_md5"))


# ------------------------------------------------------------- T6-T8, T21
def _sql_parse(ci: bool) -> str:
    fl = "(?is)" if ci else "(?s)"
    rx = f"'{fl}<searches>(.*?)</searches>|<search>(.*?)</search>|<answer>(.*?)</answer>'"
    blk = f"regexp_extract(response, {rx}, 0)"
    kind = (f"(CASE WHEN {blk} = '' THEN NULL WHEN starts_with(lower({blk}), '<searches>') THEN 'searches' "
            f"WHEN starts_with(lower({blk}), '<search>') THEN 'search' ELSE 'answer' END)")
    multi = (f"list_filter(list_transform(regexp_extract_all(regexp_extract(response, {rx}, 1), "
             f"'{fl}<search>(.*?)</search>', 1), lambda q: {sql_strip('q')}), lambda q: q <> '')")
    single = sql_strip(f"regexp_extract(response, {rx}, 2)")
    queries = (f"(CASE WHEN {kind} = 'searches' THEN {multi} "
               f"WHEN {kind} = 'search' AND {single} <> '' THEN [{single}] ELSE []::VARCHAR[] END)")
    action = (f"(CASE WHEN {kind} = 'answer' THEN 'answer' "
              f"WHEN {kind} IN ('search', 'searches') AND len({queries}) > 0 THEN 'search' END)")
    answer = f"(CASE WHEN {kind} = 'answer' THEN {sql_strip(f'regexp_extract(response, {rx}, 3)')} END)"
    return action, queries, answer, blk


_a, _qs, _ans, _blk = _sql_parse(False)
_aci, _qsci, _ansci, _ = _sql_parse(True)


@register("parse_actions", sql=f"""
WITH {SQL_FX['responses']}
SELECT sample_id, turn_idx, {_a} AS action, len({_qs})::BIGINT AS n_queries,
       array_to_string({_qs}, chr(10)) AS queries, {_ans} AS answer,
       {_aci} AS action_ci, len({_qsci})::BIGINT AS n_queries_ci, {_ansci} AS answer_ci,
       md5(CASE WHEN {_blk} = '' THEN response ELSE {_blk} END) AS first_block_md5,
       replace(response || '<|endoftext|>', '<|endoftext|>', '') = response AS pad_removed
FROM responses""")
def q_parse_actions(spark, sf_dir):
    """First action of every agent response in both case modes."""
    r = fx.responses(_t(spark, sf_dir))
    p = A.parse_action("response")
    pci = A.parse_action("response", ignore_case=True)
    return r.select(
        "sample_id", "turn_idx", p["action"].alias("action"),
        F.size(p["queries"]).cast("long").alias("n_queries"),
        F.array_join(p["queries"], "\n").alias("queries"), p["answer"].alias("answer"),
        pci["action"].alias("action_ci"), F.size(pci["queries"]).cast("long").alias("n_queries_ci"),
        pci["answer"].alias("answer_ci"),
        F.md5(A.first_action_block("response")).alias("first_block_md5"),
        (X.remove_pad(F.concat("response", F.lit("<|endoftext|>")), "<|endoftext|>")
         == F.col("response")).alias("pad_removed"))


# ---------------------------------------------------------- T9-T13
def _sql_skeleton(x: str) -> str:
    pos = f"strpos({x}, '<|im_start|>assistant')"
    s = f"(CASE WHEN {pos} > 0 THEN substr({x}, {pos} + 21) END)"
    s = f"regexp_replace({s}, '[-]', 'x', 'g')"
    for i, t in enumerate(A.FORMAT_TAGS):
        s = f"replace({s}, '<{t}>', '{chr(0xE000 + 2 * i)}')"
        s = f"replace({s}, '</{t}>', '{chr(0xE001 + 2 * i)}')"
    s = f"regexp_replace({s}, '\\s+', '', 'g')"
    s = f"regexp_replace({s}, '[^-]+', 'x', 'g')"
    s = f"translate({s}, '{''.join(chr(0xE000 + i) for i in range(8))}', 'abcdefgh')"
    return s


SQL_VALID = f"coalesce(regexp_full_match({_sql_skeleton('full_sequence')}, 'ax?b(?:cx?dex?fax?b)*gx?h'), false)"
_INFO = f"list_transform(regexp_extract_all(full_sequence, '(?s)<information>(.*?)</information>', 1), lambda b: {sql_strip('b')})"
SQL_RETRIEVED = (f"(len(list_filter({_INFO}, lambda b: len(list_filter(golden_answers, lambda g: "
                 f"contains({sql_normalize_answer('b')}, {sql_normalize_answer('g')}))) > 0)) > 0)")


@register("extract_tags", sql=f"""
WITH {SQL_FX['sequences']}
SELECT row_id, {sql_extract_answer('full_sequence')} AS answer,
       {sql_extract_answer('full_sequence', 1)} AS answer_any,
       regexp_extract_all(full_sequence, '(?s)<search>(.*?)</search>', 1)[-1] AS last_query,
       len({_INFO})::BIGINT AS n_info, array_to_string({_INFO}, '|') AS info,
       (len(string_split(full_sequence, '<think>')) - 1)::BIGINT AS think_open,
       (len(string_split(full_sequence, '</think>')) - 1)::BIGINT AS think_close,
       (len(string_split(full_sequence, '<answer>')) - 1)::BIGINT AS answer_open,
       {SQL_VALID} AS valid_format
FROM sequences""")
def q_extract_tags(spark, sf_dir):
    """Answers, last query, information blocks, tag counts, format validity."""
    s = fx.sequences(_t(spark, sf_dir))
    bal = A.tag_balance("full_sequence")
    info = A.information_blocks("full_sequence")
    return s.select(
        "row_id", A.extract_answer("full_sequence").alias("answer"),
        A.extract_answer("full_sequence", min_matches=1).alias("answer_any"),
        A.last_query("full_sequence").alias("last_query"),
        F.size(info).cast("long").alias("n_info"), F.array_join(info, "|").alias("info"),
        bal["think_open"].cast("long").alias("think_open"),
        bal["think_close"].cast("long").alias("think_close"),
        bal["answer_open"].cast("long").alias("answer_open"),
        A.valid_sequence("full_sequence").alias("valid_format"))


@register("format_validity_responses", sql=f"""
WITH {SQL_FX['responses']}, s AS (
  SELECT sample_id, turn_idx, '<|im_start|>assistant' || chr(10) || response AS full_sequence FROM responses)
SELECT sample_id, turn_idx, {SQL_VALID} AS valid_format FROM s""")
def q_format_validity_responses(spark, sf_dir):
    """T13 over every agent response behind an assistant marker."""
    r = fx.responses(_t(spark, sf_dir))
    s = r.select("sample_id", "turn_idx",
                 F.concat(F.lit("<|im_start|>assistant\n"), "response").alias("full_sequence"))
    return s.select("sample_id", "turn_idx", A.valid_sequence("full_sequence").alias("valid_format"))


# ------------------------------------------------------------ T14, T20, T22
@register("sanitize_queries", sql=f"""
SELECT item_id, {sql_strip(
    "regexp_replace(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), "
    "'[\\t\\r\\f\\v\\n]', ' ', 'g'), '\\s+', ' ', 'g')")} AS sanitized
FROM benchmark""")
def q_sanitize_queries(spark, sf_dir):
    """T14 over the benchmark texts."""
    b = _t(spark, sf_dir).benchmark
    return b.select("item_id", X.sanitize_query("text").alias("sanitized"))


_KW = " OR ".join(f"contains(lower(text), '{k}')" for k in X.QUOTA_ERROR_KEYWORDS)


@register("quota_errors", sql=f"""
SELECT conv_id, turn, coalesce({_KW}, false) AS is_quota_error FROM conversations""")
def q_quota_errors(spark, sf_dir):
    """T20 keyword detection over conversation texts."""
    c = _t(spark, sf_dir).conversations
    return c.select("conv_id", "turn", X.is_quota_error("text").alias("is_quota_error"))


def _sql_ntok(x):
    s = sql_strip(x)
    return f"(CASE WHEN {s} = '' THEN 0 ELSE len(regexp_split_to_array({s}, '\\s+')) END)"


@register("prompt_lengths", sql=f"""
SELECT conv_id, turn, sum(length(text)) OVER w::BIGINT AS cum_chars,
       sum({_sql_ntok('text')}) OVER w::BIGINT AS cum_tokens
FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_prompt_lengths(spark, sf_dir):
    """Running prompt length (chars, tokens) per conversation turn."""
    from searchlane.operators.rollouts import prompt_lengths
    c = _t(spark, sf_dir).conversations
    return prompt_lengths(c, key="conv_id", order="turn", text="text").select(
        "conv_id", "turn", "cum_chars", "cum_tokens")


# --------------------------------------------------------------- R1-R4, R13
_ANS = sql_extract_answer("full_sequence")


@register("em_scores", sql=f"""
WITH {SQL_FX['sequences']}
SELECT row_id,
  (CASE WHEN {_ANS} IS NULL THEN 0.0 WHEN {sql_em(_ANS, 'golden_answers')} THEN 1.0 ELSE 0.0 END)::DOUBLE AS em_score,
  (CASE WHEN {_ANS} IS NULL THEN 0.0 WHEN {sql_subem(_ANS, 'golden_answers')} THEN 1.0 ELSE 0.0 END)::DOUBLE AS subem_score
FROM sequences""")
def q_em_scores(spark, sf_dir):
    """EM and SubEM scores of every sequence."""
    s = fx.sequences(_t(spark, sf_dir))
    s = R.score_em(s, out="em_score")
    s = R.score_subem(s, out="subem_score")
    return s.select("row_id", "em_score", "subem_score")


_EMF = f"""(CASE WHEN {_ANS} IS NULL THEN (CASE WHEN {SQL_VALID} THEN (CASE WHEN {SQL_RETRIEVED} THEN 0.2 + 0.1 ELSE 0.2 END) ELSE 0.0 END)
  WHEN {sql_em(_ANS, 'golden_answers')} THEN (CASE WHEN {SQL_VALID} THEN 1.0 ELSE 1.0 - 0.2 END)
  WHEN {SQL_VALID} THEN (CASE WHEN {SQL_RETRIEVED} THEN 0.2 + 0.1 ELSE 0.2 END)
  ELSE 0.1 END)::DOUBLE"""


@register("em_format_scores", sql=f"""
WITH {SQL_FX['sequences']}
SELECT row_id, {SQL_VALID} AS valid_format, {SQL_VALID} AND {SQL_RETRIEVED} AS retrieval_correct,
       {_EMF} AS score
FROM sequences""")
def q_em_format_scores(spark, sf_dir):
    """R4 + R13 + T13: format-aware EM with retrieval credit."""
    s = fx.sequences(_t(spark, sf_dir))
    ok = A.valid_sequence("full_sequence")
    return R.score_em_format(s).select(
        "row_id", ok.alias("valid_format"),
        (ok & A.retrieval_correct("full_sequence", "golden_answers")).alias("retrieval_correct"),
        "score")


@register("reward_dispatch", sql=f"""
WITH {SQL_FX['sequences']}
SELECT row_id, data_source, {_EMF} AS score FROM sequences""")
def q_reward_dispatch(spark, sf_dir):
    """Reward dispatch by data source (format-aware registry)."""
    s = fx.sequences(_t(spark, sf_dir))
    return R.score_rollouts(s, registry="em_format").select("row_id", "data_source", "score")


@register("reward_registries", sql=f"""
WITH {SQL_FX['sequences']}
SELECT row_id, (CASE WHEN row_id % 2 = 0 THEN CASE WHEN {_ANS} IS NULL THEN 0.0
                          WHEN {sql_em(_ANS, '[golden_answers[1]]')} THEN 1.0 ELSE 0.0 END
                     ELSE length(response) / 1000.0 END)::DOUBLE AS score FROM sequences""")
def q_reward_registries(spark, sf_dir):
    """A caller's registry; one source is scored by exact match on a single golden
    string (R1), the other by a rule of the caller."""
    s = (fx.sequences(_t(spark, sf_dir)).withColumn("golden_answers", F.element_at("golden_answers", 1))
         .withColumn("data_source", F.when(F.col("row_id") % 2 == 0, "exact").otherwise("length")))
    own = {("exact",): lambda d: F.col("exact"), ("length",): lambda d: F.length("response") / 1000.0}
    return R.score_rollouts(R.score_em(s, out="exact"), registry=own).select("row_id", "score")


@register("score_by_source", sql=f"""
WITH {SQL_FX['sequences']}, {SQL_FX['rollout_log']}
SELECT split, coalesce(data_source, 'unknown') AS data_source, avg(score)::DOUBLE AS mean_score,
       count(score)::BIGINT AS n_scored
FROM rollout_log GROUP BY split, coalesce(data_source, 'unknown')""")
def q_score_by_source(spark, sf_dir):
    """Mean score per split and data source over the rollout log."""
    log = fx.rollout_log(_t(spark, sf_dir))
    return R.score_by_source(log, by=("split",))


@register("pass_at_n", sql=f"""
WITH {SQL_FX['sequences']}, {SQL_FX['rollout_log']},
best AS (SELECT data_source, golden_answers[1] AS golden, max(score) AS best FROM rollout_log GROUP BY ALL)
SELECT avg(CASE WHEN best = 1.0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS pass_at_n, count(*)::BIGINT AS n_prompts
FROM best""")
def q_pass_at_n(spark, sf_dir):
    """The log's samples of one data source and golden answer are the samples of a prompt."""
    log = fx.rollout_log(_t(spark, sf_dir)).withColumn("golden", F.element_at("golden_answers", 1))
    return R.pass_at_n(log, "score", prompt=("data_source", "golden"))


# ------------------------------------------------------------------ R5, R8
_GSM_N = "CAST(l_extendedprice AS BIGINT)"


def _gsm_fixture_spark(t):
    li = t.lineitem
    n = li.l_extendedprice.cast("long")
    shown = F.when(li.l_linenumber % 3 == 0, F.format_number(n, 0)).otherwise(n.cast("string"))
    wrong = (li.l_linenumber % 4 == 0)
    val = F.when(wrong, (n + 1).cast("string")).otherwise(shown)
    sol = F.when(li.l_linenumber % 5 == 0,
                 F.concat(F.lit("The answer is "), val, F.lit(" dollars.")))\
        .otherwise(F.concat(F.lit("We buy "), li.l_quantity.cast("long").cast("string"),
                            F.lit(" items.\n#### "), val))
    return li.select("l_orderkey", "l_linenumber", sol.alias("solution"),
                     n.cast("string").alias("ground_truth"))


_GSM_SQL_FX = f"""g AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_linenumber % 5 = 0 THEN 'The answer is ' || v || ' dollars.'
         ELSE 'We buy ' || CAST(l_quantity AS BIGINT) || ' items.' || chr(10) || '#### ' || v END AS solution,
    CAST({_GSM_N} AS VARCHAR) AS ground_truth
  FROM (SELECT *, CASE WHEN l_linenumber % 4 = 0 THEN CAST({_GSM_N} + 1 AS VARCHAR)
                       WHEN l_linenumber % 3 = 0 THEN format('{{:,}}', {_GSM_N})
                       ELSE CAST({_GSM_N} AS VARCHAR) END AS v FROM lineitem))"""

_STRICT = ("(CASE WHEN regexp_matches(solution, '#### (\\-?[0-9\\.\\,]+)') THEN "
           "replace(replace(regexp_extract(solution, '#### (\\-?[0-9\\.\\,]+)', 1), ',', ''), '$', '') END)")
_TOKS = "regexp_extract_all(solution, '(\\-?[0-9\\.\\,]+)', 1)"
_FLEX = (f"(CASE WHEN len({_TOKS}) = 0 THEN NULL "
         f"WHEN len(list_filter({_TOKS}, lambda x: x NOT IN ('', '.'))) > 0 "
         f"THEN list_filter({_TOKS}, lambda x: x NOT IN ('', '.'))[-1] ELSE {_TOKS}[1] END)")


@register("gsm8k_scores", sql=f"""
WITH {_GSM_SQL_FX}
SELECT l_orderkey, l_linenumber,
  (CASE WHEN {_STRICT} IS NULL THEN 0.0 WHEN {_STRICT} = ground_truth THEN 1.0 ELSE 0.0 END)::DOUBLE AS strict_score,
  (CASE WHEN {_FLEX} IS NULL THEN 0.0 WHEN {_FLEX} = ground_truth THEN 1.0 ELSE 0.0 END)::DOUBLE AS flexible_score
FROM g""")
def q_gsm8k_scores(spark, sf_dir):
    """Strict and flexible gsm8k scoring over line items."""
    g = _gsm_fixture_spark(_t(spark, sf_dir))
    g = R.score_gsm8k(g, "solution", "ground_truth", "strict", out="strict_score")
    g = R.score_gsm8k(g, "solution", "ground_truth", "flexible", out="flexible_score")
    return g.select("l_orderkey", "l_linenumber", "strict_score", "flexible_score")


@register("multiply_scores", sql="""
WITH m AS (
  SELECT o_orderkey, o_custkey * o_orderkey AS gt,
    CASE o_orderkey % 4
      WHEN 0 THEN 'User: multiply. Assistant: <answer> ' || (o_custkey * o_orderkey) || ' </answer>'
      WHEN 1 THEN 'User: multiply. Assistant: <answer>' || (o_custkey * o_orderkey + 1) || '</answer>'
      WHEN 2 THEN 'User: multiply. Assistant: <answer>about ' || o_custkey || '</answer>'
      ELSE 'no marker <answer>' || (o_custkey * o_orderkey) || '</answer>' END AS solution
  FROM orders),
a AS (SELECT *, TRY_CAST(trim(regexp_extract_all(substr(solution, strpos(solution, 'Assistant:') + 10),
                 '<answer>(.*?)</answer>', 1)[-1]) AS BIGINT) AS ans,
             strpos(solution, 'Assistant:') > 0 AS has_marker FROM m)
SELECT o_orderkey, (CASE WHEN NOT has_marker OR ans IS NULL THEN 0.0 WHEN ans = gt THEN 1.0 ELSE 0.1 END)::DOUBLE AS score
FROM a""")
def q_multiply_scores(spark, sf_dir):
    """Multiply-task scoring over orders."""
    o = _t(spark, sf_dir).orders
    gt = o.o_custkey * o.o_orderkey
    m = o.o_orderkey % 4
    sol = (F.when(m == 0, F.concat(F.lit("User: multiply. Assistant: <answer> "), gt.cast("string"), F.lit(" </answer>")))
           .when(m == 1, F.concat(F.lit("User: multiply. Assistant: <answer>"), (gt + 1).cast("string"), F.lit("</answer>")))
           .when(m == 2, F.concat(F.lit("User: multiply. Assistant: <answer>about "), o.o_custkey.cast("string"), F.lit("</answer>")))
           .otherwise(F.concat(F.lit("no marker <answer>"), gt.cast("string"), F.lit("</answer>"))))
    df = o.select("o_orderkey", gt.alias("gt"), sol.alias("solution"))
    return R.score_multiply(df, "solution", "gt").select("o_orderkey", "score")


# ---------------------------------------------------------- R6, R7 (rows-only)
# Oracle note: the fixture equations only add numbers, so SQL can take their sum as the
# value; the Spark side evaluates the expression with the general AST evaluator.
_CD_SQL = """
WITH agg AS (SELECT l_orderkey, count(*) AS a, max(CAST(l_quantity AS BIGINT)) AS b FROM lineitem GROUP BY l_orderkey),
f AS (SELECT l_orderkey, a, b,
        '<|im_start|>assistant' || chr(10) || 'Let me think.' || chr(10) || '<answer>'
        || (CASE WHEN l_orderkey % 3 = 2 THEN a || ' + ' || b || ' + 1' ELSE a || ' + ' || b END) || '</answer>' AS solution,
        (CASE WHEN l_orderkey % 3 = 1 THEN a + b + 1 ELSE a + b END)::DOUBLE AS target FROM agg),
e AS (SELECT *, trim(regexp_extract_all(split_part(solution, chr(10), -1), '<answer>(.*?)</answer>', 1)[-1]) AS eq FROM f),
u AS (SELECT *, list_sort(list_transform(regexp_extract_all(eq, '(\\d+)', 1), lambda x: CAST(x AS BIGINT))) AS used,
             list_sort([a, b]) AS avail FROM e)
SELECT l_orderkey,
  (CASE WHEN eq IS NULL THEN 0.0 WHEN used <> avail THEN 0.1
        WHEN abs(list_sum(used) - target) < 1e-5 THEN 1.0 ELSE 0.1 END)::DOUBLE AS score
FROM u"""


@register("countdown_scores", sql=_CD_SQL)
def q_countdown_scores(spark, sf_dir):
    """R7 over orders: numbers = [lines, qty of line 1, customer key % 100]."""
    t = _t(spark, sf_dir)
    li = t.lineitem
    agg = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("a"),
                                       F.max(li.l_quantity.cast("long")).alias("b"))
    a, b = F.col("a"), F.col("b")
    eq = F.concat(a.cast("string"), F.lit(" + "), b.cast("string"))
    v = F.col("l_orderkey") % 3
    sol = F.concat(F.lit("<|im_start|>assistant\nLet me think.\n<answer>"),
                   F.when(v == 2, F.concat(eq, F.lit(" + 1"))).otherwise(eq), F.lit("</answer>"))
    target = F.when(v == 1, a + b + 1).otherwise(a + b).cast("double")
    df = agg.select("l_orderkey", sol.alias("solution"), target.alias("target"),
                    F.array(a, b).alias("numbers"))
    return R.score_countdown(df, "solution", "target", "numbers").select("l_orderkey", "score")


# Twelve written forms of one answer by p_partkey % 12 and what the public MATH conventions
# make of each against the ground truth \\frac{a}{b} (a = key % 9 + 1, b = key % 7 + 2):
# 0 a/b, 1 \\dfrac without braces, 2 spaces inside: equal; 3 escaped percent: goes, equal;
# 4 bare percent: stays, unequal; 5 spaced box up to the dollar sign: equal; 6 x= prefix:
# equal; 7 units: cut, equal; 8 unclosed brace: 0; 9 no box: 0; 10 \\fbox: 0;
# 11 the last of two boxes counts: unequal unless (a, b) = (1, 2), as 0.5 is \\frac{1}{2}.
@register("math_scores", sql="""
SELECT p_partkey, (CASE WHEN p_partkey % 12 IN (0, 1, 2, 3, 5, 6, 7) THEN 1.0
                        WHEN p_partkey % 12 = 11 AND p_partkey % 9 + 1 = 1 AND p_partkey % 7 + 2 = 2 THEN 1.0
                        ELSE 0.0 END)::DOUBLE AS score FROM part""")
def q_math_scores(spark, sf_dir):
    """R6 + T19 over parts: boxed answers in twelve written forms."""
    return R.score_math(_boxed_answers(spark, sf_dir), "solution", "gt").select("p_partkey", "score")


def _boxed_answers(spark, sf_dir):
    p = _t(spark, sf_dir).part
    k = p.p_partkey
    a, b = (k % 9 + 1).cast("string"), (k % 7 + 2).cast("string")
    frac = F.concat(F.lit("\\frac{"), a, F.lit("}{"), b, F.lit("}"))
    box = lambda *x: F.concat(F.lit("so \\boxed{"), *x, F.lit("}."))
    forms = [box(a, F.lit("/"), b), box(F.lit("\\dfrac"), a, b), box(F.lit(" \\frac {"), a, F.lit("} {"), b, F.lit("}")),
             box(frac, F.lit("\\%")), box(frac, F.lit("%")), F.concat(F.lit("so $\\boxed "), frac, F.lit("$ holds")),
             box(F.lit("x="), frac), box(frac, F.lit("\\text{ cm}")), F.concat(F.lit("so \\boxed{"), frac),
             F.concat(F.lit("so "), frac), F.concat(F.lit("\\fbox{"), frac, F.lit("}")),
             F.concat(box(frac), F.lit(" or "), box(F.lit(".5")))]
    sol = F
    for i, form in enumerate(forms):
        sol = sol.when(k % 12 == i, form)
    return p.select("p_partkey", sol.alias("solution"), frac.alias("gt"))


@register("eval_scores", sql="""
SELECT 'lighteval/MATH' AS data_source, count(*)::BIGINT AS n,
       round(avg(CASE WHEN p_partkey % 12 IN (0, 1, 2, 3, 5, 6, 7) THEN 1.0
                      WHEN p_partkey % 12 = 11 AND p_partkey % 9 + 1 = 1 AND p_partkey % 7 + 2 = 2 THEN 1.0
                      ELSE 0.0 END), 6)::DOUBLE AS mean_score FROM part""")
def q_eval_scores(spark, sf_dir):
    """R9 with the evaluation registry (MATH): responses dispatched by data source, mean score."""
    df = _boxed_answers(spark, sf_dir).select(
        F.lit("lighteval/MATH").alias("data_source"), F.col("solution").alias("full_sequence"),
        F.array("gt").alias("golden_answers"))
    return R.score_rollouts(df, registry="eval").groupBy("data_source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@register("format_reasons")
def q_format_reasons(spark, sf_dir):
    """T13 reason (exact messages, Arrow pandas UDF) next to the JVM flag for
    every sequence."""
    s = fx.sequences(_t(spark, sf_dir))
    return s.select("row_id", A.format_reason("full_sequence").alias("reason"),
                    A.valid_sequence("full_sequence").alias("valid_format"))
