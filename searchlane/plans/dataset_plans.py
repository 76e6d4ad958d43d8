"""Registered dataset-building and batching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlane.functions import rl
from searchlane.operators import batching as BT
from searchlane.operators import datasets as DS
from searchlane.operators import rollouts as RO
from searchlane.plans.registry import SQL_FX, register, sql_lit, sql_strip
from searchlane.sources import fixtures as fx
from searchlane.sources.tables import Tables


def _sql_fill(template: str, **cols) -> str:
    import re
    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        out.append(sql_lit(template[pos:m.start()]))
        out.append(cols[m.group(1)])
        pos = m.end()
    out.append(sql_lit(template[pos:]))
    return "(" + " || ".join(out) + ")"


_SQ = sql_strip("question")
_NQ = f"(CASE WHEN {_SQ} = '' THEN {_SQ} WHEN NOT ends_with({_SQ}, '?') THEN {_SQ} || '?' ELSE {_SQ} END)"


@register("prompt_rows", sql=f"""
WITH {SQL_FX['qa']}
SELECT qid AS "index", 'nq' AS data_source, 'user' AS role, 'fact-reasoning' AS ability, 'rule' AS style,
       'train' AS split, len(golden_answers)::BIGINT AS n_targets, {_NQ} = '' AS empty_question,
       md5({_sql_fill(DS.TEMPLATE_SEARCH, question=_NQ)}) AS search_md5,
       md5({_sql_fill(DS.TEMPLATE_DIRECT, question=_NQ)}) AS direct_md5,
       md5({_sql_fill(DS.TEMPLATE_RAG, question=_NQ, context='golden_answers[2]')}) AS rag_md5
FROM qa""")
def q_prompt_rows(spark, sf_dir):
    """Question normalisation, the three templates, nested prompt rows."""
    qa = fx.qa(Tables(spark, sf_dir)).withColumnRenamed("qid", "index")
    rows = DS.build_prompt_rows(qa.withColumn("ctx", F.element_at("golden_answers", 2)), "nq", "train",
                                "nq_search", context_col=None)
    direct = DS.make_prompt(DS.normalize_question("question"), "nq")
    rag = DS.make_prompt(DS.normalize_question("question"), "nq_rag", F.element_at("golden_answers", 2))
    extra = qa.select("index", F.md5(direct).alias("direct_md5"), F.md5(rag).alias("rag_md5"))
    return rows.select(
        F.col("extra_info.index").alias("index"), "data_source", F.col("prompt")[0]["role"].alias("role"),
        "ability", F.col("reward_model.style").alias("style"), F.col("extra_info.split").alias("split"),
        F.size("reward_model.ground_truth.target").cast("long").alias("n_targets"), "empty_question",
        F.md5(F.col("prompt")[0]["content"]).alias("search_md5")).join(extra, "index")


_SEARCH_CONTENT = _sql_fill(DS.TEMPLATE_SEARCH, question=_NQ)
_EXTRACTED = f"regexp_extract({_SEARCH_CONTENT}, '(?s)^.*Question: (.*)$', 1)"
_NQ2 = _NQ.replace("question", f"({_EXTRACTED})")


@register("rewrite_prompts", sql=f"""
WITH {SQL_FX['qa']}
SELECT qid, {sql_strip(_EXTRACTED)} AS question, md5({_sql_fill(DS.TEMPLATE_DIRECT, question=sql_strip(_NQ2))}) AS rewritten_md5
FROM qa""")
def q_rewrite_prompts(spark, sf_dir):
    """P4 + P5: question extracted after the last 'Question: ' marker, prompt
    rewritten to another template."""
    qa = fx.qa(Tables(spark, sf_dir)).withColumnRenamed("qid", "index")
    rows = DS.build_prompt_rows(qa, "nq", "train", "nq_search")
    q = DS.extract_question(F.col("prompt")[0]["content"])
    rw = DS.rewrite_prompts(rows, DS.TEMPLATE_DIRECT)
    return rw.select(F.col("extra_info.index").alias("qid"), F.lit(None).cast("string").alias("_x"),
                     F.md5(F.col("prompt")[0]["content"]).alias("rewritten_md5")).drop("_x").join(
        rows.select(F.col("extra_info.index").alias("qid"), F.regexp_replace(q, r"(?U)^\s+|\s+$", "")
                    .alias("question")), "qid")


@register("decision_prompts", sql=f"""
WITH {SQL_FX['qa']}
SELECT qid, md5({_sql_fill(DS.TEMPLATE_DECISION, question=sql_strip(_NQ2))}) AS rewritten_md5 FROM qa""")
def q_decision_prompts(spark, sf_dir):
    """P5: search prompts rewritten to the decision template with parallel searches."""
    qa = fx.qa(Tables(spark, sf_dir)).withColumnRenamed("qid", "index")
    rw = DS.rewrite_prompts(DS.build_prompt_rows(qa, "nq", "train", "nq_search"), DS.TEMPLATE_DECISION)
    return rw.select(F.col("extra_info.index").alias("qid"), F.md5(F.col("prompt")[0]["content"]).alias("rewritten_md5"))


@register("slice_rows", sql=f"""
WITH {SQL_FX['qa']}
SELECT qid, question FROM qa ORDER BY qid LIMIT 512 OFFSET 100""")
def q_slice_rows(spark, sf_dir):
    """P8 (and V18's question window): rows 100..611 in key order."""
    qa = fx.qa(Tables(spark, sf_dir))
    return DS.slice_rows(qa, ["qid"], offset=100, limit=512).select("qid", "question")


@register("sft_projection", sql=f"""
WITH {SQL_FX['responses']},
s AS (SELECT sample_id, (SELECT count(*) FROM conversations c2 WHERE c2.conv_id = r.sample_id
                           AND c2.role = 'assistant' AND c2.turn < r.turn_idx) AS step,
             (CASE WHEN regexp_extract(response, '(?s)<searches>(.*?)</searches>|<search>(.*?)</search>|<answer>(.*?)</answer>', 0) LIKE '<answer>%' THEN 'answer' END) AS action
      FROM responses r),
g AS (SELECT sample_id FROM s WHERE step <= 3 GROUP BY sample_id HAVING count(CASE WHEN action = 'answer' THEN 1 END) > 0),
m AS (SELECT conv_id, count(*)::BIGINT AS n_messages, md5(string_agg(role || ':' || text, chr(30) ORDER BY turn)) AS messages_md5
      FROM conversations GROUP BY conv_id)
SELECT m.conv_id AS sample_id, n_messages, messages_md5 FROM m JOIN g ON g.sample_id = m.conv_id""")
def q_sft_projection(spark, sf_dir):
    """P6 + P7: completed rollouts projected to their message lists."""
    t = Tables(spark, sf_dir)
    status = RO.collect_status(RO.replay_rollouts(fx.responses(t), 3))
    msgs = RO.gather_samples(t.conversations.withColumn("m", F.struct("role", F.col("text").alias("content"))),
                             "conv_id", "turn", "m").withColumnRenamed("conv_id", "sample_id") \
        .withColumnRenamed("responses", "messages")
    done = DS.completed_only(status.join(msgs, "sample_id"))
    sft = DS.to_sft(done, keep=("sample_id",))
    return sft.select("sample_id", F.size("messages").cast("long").alias("n_messages"),
                      F.md5(F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])),
                                         "\u001e")).alias("messages_md5"))


@register("truncate_token_arrays", sql=f"""
WITH {SQL_FX['token_rows']}
SELECT row_id,
       list_sum(CASE WHEN len(responses) > 3 THEN responses[len(responses) - 2:] ELSE responses END)::BIGINT AS left_sum,
       list_sum(responses[1:3])::BIGINT AS right_sum,
       list_sum(CASE WHEN len(responses) >= 8 THEN responses[len(responses) - 7:]
                ELSE list_concat(list_transform(range(8 - len(responses)), lambda x: 0), responses) END)::BIGINT AS padded_sum,
       (CASE WHEN len(responses) >= 8 THEN 8 ELSE 8 END)::BIGINT AS padded_len
FROM token_rows""")
def q_truncate_token_arrays(spark, sf_dir):
    """P14 + M6: left / right truncation to 3 tokens and left padding to 8."""
    tr = fx.token_rows(Tables(spark, sf_dir))
    s = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    padded = rl.pad_to("responses", 8, F.lit(0).cast("long"), left=True)
    return tr.select("row_id", s(rl.truncate_array("responses", 3, "left")).alias("left_sum"),
                     s(rl.truncate_array("responses", 3, "right")).alias("right_sum"),
                     s(padded).alias("padded_sum"), F.size(padded).cast("long").alias("padded_len"))


@register("sample_exact", sql=f"""
WITH {SQL_FX['sequences']}, {SQL_FX['rollout_log']},
r AS (SELECT split, "index", row_number() OVER (PARTITION BY split ORDER BY md5(CAST("index" AS VARCHAR) || '#42'), "index") AS rn
      FROM rollout_log)
SELECT split, "index" FROM r
WHERE rn <= (SELECT greatest(1, min(c) // 2) FROM (SELECT count(*) AS c FROM rollout_log GROUP BY split))""")
def q_sample_exact(spark, sf_dir):
    """Seeded exact-size subsets per split of the rollout log, half of the smaller split."""
    log = fx.rollout_log(Tables(spark, sf_dir))
    smallest = log.groupBy("split").count().agg(F.min("count")).first()[0]
    return DS.sample_exact(log, max(1, smallest // 2), "index", seed=42, by="split").select("split", "index")


@register("shuffle_batches", sql=f"""
WITH {SQL_FX['qa']},
i AS (SELECT qid, row_number() OVER (ORDER BY md5(CAST(qid AS VARCHAR) || '#42'), qid) - 1 AS idx FROM qa),
n AS (SELECT count(*) AS c FROM qa)
SELECT qid, (idx // 64)::BIGINT AS batch_id FROM i, n WHERE idx < (n.c // 64) * 64""")
def q_shuffle_batches(spark, sf_dir):
    """Seeded shuffle, batches of 64, short last batch dropped."""
    qa = fx.qa(Tables(spark, sf_dir))
    return DS.shuffle_batches(qa, 64, "qid").select("qid", "batch_id")


@register("repeat_rows", sql="""
SELECT o_orderkey AS row_idx, r AS rep FROM orders, generate_series(0, 4) AS g(r)""")
def q_repeat_rows(spark, sf_dir):
    """Every order repeated 5 times (interleaved order key)."""
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("row_idx"))
    return BT.repeat_rows(o, 5).select("row_idx", F.col("rep").cast("long").alias("rep"))


@register("mini_batches", sql="""
WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx FROM orders),
n AS (SELECT count(*) AS c FROM orders),
b AS (SELECT o_orderkey, row_idx, false AS is_pad FROM i
      UNION ALL
      SELECT o_orderkey, row_idx + n.c, true FROM i, n WHERE row_idx < (128 - n.c % 128) % 128)
SELECT o_orderkey, row_idx::BIGINT AS row_idx, (row_idx // 64)::BIGINT AS batch_id, is_pad FROM b""")
def q_mini_batches(spark, sf_dir):
    """Global row index, 64-row mini-batches, padding to a multiple of 128."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey")
    idx = BT.with_row_index(o, ["o_orderkey"])
    padded = BT.pad_to_divisor(idx, 128)
    return BT.mini_batches(padded, 64).select("o_orderkey", "row_idx", "batch_id", "is_pad")


@register("row_index", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
       (row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) - 1)::BIGINT AS row_idx
FROM lineitem""")
def q_row_index(spark, sf_dir):
    """Dense index over many columns of every lineitem row, by descending price."""
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return BT.with_row_index(li, [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"])


@register("balanced_partitions", sql=f"""
WITH {SQL_FX['token_rows']},
x AS (SELECT row_id, len(responses) AS n, row_number() OVER (ORDER BY row_id) - 1 AS i FROM token_rows),
b AS (SELECT *, i // 256 AS batch_id, row_number() OVER (PARTITION BY i // 256 ORDER BY n DESC, i) - 1 AS r FROM x),
p AS (SELECT *, CASE WHEN (r // 4) % 2 = 0 THEN r % 4 ELSE 3 - r % 4 END AS part FROM b),
t AS (SELECT batch_id, part, sum(n) AS tokens FROM p GROUP BY ALL)
SELECT batch_id::BIGINT AS batch_id, min(tokens)::BIGINT AS min_tokens, max(tokens)::BIGINT AS max_tokens,
       avg(tokens)::DOUBLE AS mean_tokens, ceil(sum(tokens) / 64.0)::INTEGER AS n_micro FROM t GROUP BY batch_id""")
def q_balanced_partitions(spark, sf_dir):
    """Length-balanced partitions, dealt in snake order by length inside each fixed
    256-row training batch of the token table, with the per-batch spread and micro-batch count."""
    tr = fx.token_rows(Tables(spark, sf_dir)).select("row_id", F.size("responses").alias("seqlen"))
    idx = BT.mini_batches(BT.with_row_index(tr, ["row_id"]), 256)
    rep = BT.balance_report(BT.snake_batches(idx, 4), idx)
    return rep.join(BT.micro_batch_count(idx, 64), "batch_id")


@register("popped_rows", sql="""
SELECT conv_id, turn, length(text)::BIGINT AS n_chars FROM conversations WHERE role = 'user'""")
def q_popped_rows(spark, sf_dir):
    """P12 + P13: rows chosen by a mask, and the columns that a pop leaves."""
    from searchlane.operators.batching import pop_columns, select_rows
    c = Tables(spark, sf_dir).conversations.withColumn("n_chars", F.length("text").cast("long")) \
        .withColumn("active", F.col("role") == "user")
    _, rest = pop_columns(select_rows(c, "active"), ["role", "text", "active"])
    return rest
