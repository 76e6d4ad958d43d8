"""Derived inputs built by Spark from the driver tables (FIXTURES part C).

No driver table holds agent tags, golden answers or token arrays, so each is
derived from plain columns of whole tables; their size grows with the tables.
Deterministic variant choice uses a key modulus (it picks *which* form a row
takes, it never drops rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlane.functions.text import make_passage
from searchlane.sources.tables import Tables

# The seven QA data sources of the reference's training mix.
DATA_SOURCES = ("nq", "triviaqa", "popqa", "hotpotqa", "2wikimultihopqa", "musique", "bamboogle")

PROMPT_HEAD = ("<|im_start|>system\nAnswer the question. Example: <answer> Beijing </answer>"
               "<|im_end|>\n<|im_start|>user\nQuestion: ")
PROMPT_TAIL = "<|im_end|>\n<|im_start|>assistant\n"


def corpus(t: Tables) -> DataFrame:
    """``id = doc_id``, ``contents = '"source"\\ntext'``."""
    d = t.documents
    return d.select(d.doc_id.alias("id"), make_passage(d.source, d.text).alias("contents"))


def queries(t: Tables) -> DataFrame:
    """Whole benchmark texts as search queries."""
    b = t.benchmark
    return b.select(b.item_id.alias("query_id"), b.text.alias("query"))


def qa(t: Tables) -> DataFrame:
    """Raw QA rows from ``part``: question variants by key, golden = [brand, name]."""
    p = t.part
    base = F.concat(F.lit("What is the brand of part "), p.p_partkey.cast("string"))
    m = p.p_partkey % 3
    question = (F.when(m == 0, base)
                .when(m == 1, F.concat(base, F.lit("?")))
                .otherwise(F.concat(F.lit("  "), base, F.lit(" "))))
    return p.select(p.p_partkey.alias("qid"), question.alias("question"),
                    F.array(p.p_brand, p.p_name).alias("golden_answers"))


def responses(t: Tables) -> DataFrame:
    """One agent response per assistant turn; the form is chosen by
    ``(conv_id + turn) % 5``: single search, parallel searches (one per line),
    answer, upper-case answer tags (invalid unless case-insensitive), empty
    search."""
    c = t.conversations.filter(F.col("role") == "assistant")
    v = (c.conv_id + c.turn) % 5
    txt = c.text
    resp = (F.when(v == 0, F.concat(F.lit("<think>need to look this up</think>\n<search> "), txt,
                                     F.lit(" </search>")))
            .when(v == 1, F.concat(F.lit("<think>several lookups</think>\n<searches>\n<search>"),
                                   F.replace(txt, F.lit("\n"), F.lit("</search>\n<search>")),
                                   F.lit("</search>\n</searches>")))
            .when(v == 2, F.concat(F.lit("<think>I know it</think>\n<answer> "), txt, F.lit(" </answer>")))
            .when(v == 3, F.concat(F.lit("<ANSWER>"), txt, F.lit("</ANSWER>")))
            .otherwise(F.concat(F.lit("<search>  </search> "), txt)))
    return c.select(c.conv_id.alias("sample_id"), c.turn.alias("turn_idx"), resp.alias("response"))


def sequences(t: Tables) -> DataFrame:
    """Full prompt+response sequences with golden answers, from ``part``.

    wrong answer when key % 4 = 0, no final answer when key % 7 = 0, a search
    without a preceding think (invalid format) when key % 5 = 0, information
    without the brand (retrieval miss) when key % 3 = 0.
    """
    p = t.part
    k = p.p_partkey
    ks = k.cast("string")
    info = F.when(k % 3 == 0, F.concat(F.lit("Doc 1(Title: "), p.p_name, F.lit(") unrelated text")))\
        .otherwise(F.concat(F.lit("Doc 1(Title: "), p.p_name, F.lit(") The brand is "), p.p_brand, F.lit(".")))
    first = F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("<think>I need the brand.</think>\n"))
    answer = F.when(k % 7 == 0, F.lit(""))\
        .otherwise(F.concat(F.lit("<answer> "),
                            F.when(k % 4 == 0, F.lit("Brand#00")).otherwise(p.p_brand),
                            F.lit(" </answer>")))
    response = F.concat(first, F.lit("<search> brand of part "), ks, F.lit(" </search>\n\n<information>"),
                        info, F.lit("</information>\n\n<think>found it</think>\n"), answer)
    prompt = F.concat(F.lit(PROMPT_HEAD), F.lit("What is the brand of part "), ks, F.lit("?"),
                      F.lit(PROMPT_TAIL))
    src = F.element_at(F.array(*[F.lit(s) for s in DATA_SOURCES]), (k % 7 + 1).cast("int"))
    return p.select(k.alias("row_id"), src.alias("data_source"), prompt.alias("prompt"),
                    response.alias("response"), F.concat(prompt, response).alias("full_sequence"),
                    F.array(p.p_brand, p.p_name).alias("golden_answers"))


def rollout_log(t: Tables) -> DataFrame:
    """Scored-rollout log records: split by key, uid null when key % 6 = 0."""
    s = sequences(t)
    k = s.row_id
    from searchlane.operators.rewards import score_em
    scored = score_em(s, "full_sequence", "golden_answers")
    return scored.select(
        F.when(k % 10 < 8, F.lit("train")).otherwise(F.lit("test")).alias("split"),
        k.alias("index"),
        F.when(k % 6 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("u"), k.cast("string"))).alias("uid"),
        "data_source", "prompt", "response", "full_sequence", "golden_answers",
        F.col("score").cast("double").alias("score"))


def token_rows(t: Tables) -> DataFrame:
    """Token batch per order: one response token per line item in line order.

    responses = part keys, old/ref log-probs and values scaled from discount,
    tax and price, info_mask = 0 on returned ('R') lines after the first, group = customer,
    batch = order key % 50, scalar score from the order's total price.
    """
    li = t.lineitem
    el = F.struct(li.l_linenumber.alias("n"), li.l_partkey.alias("tok"),
                  (-(li.l_discount + 0.05)).alias("old_lp"), (-(li.l_tax + 0.05)).alias("ref_lp"),
                  (li.l_extendedprice / 99991.0).alias("val"),
                  F.when((li.l_returnflag == "R") & (li.l_linenumber > 1), 0).otherwise(1).alias("info"))
    g = li.groupBy(li.l_orderkey.alias("row_id")).agg(F.array_sort(F.collect_list(el)).alias("_e"))
    o = t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("group_id"),
                        (F.col("o_totalprice") / 99991.0).alias("score"))
    j = g.join(o, "row_id")
    return j.select(
        "row_id", "group_id", (F.col("row_id") % 50).alias("batch_id"), "score",
        F.transform("_e", lambda e: e["tok"]).alias("responses"),
        F.transform("_e", lambda e: F.lit(1)).alias("attention_mask"),
        F.transform("_e", lambda e: e["info"]).alias("info_mask"),
        F.transform("_e", lambda e: e["old_lp"]).alias("old_log_probs"),
        F.transform("_e", lambda e: e["ref_lp"]).alias("ref_log_prob"),
        F.transform("_e", lambda e: e["val"]).alias("values"))


def label_centroid_queries(t: Tables) -> DataFrame:
    """Dense queries: the L2-normalised mean vector of every label class."""
    e = t.embeddings
    pe = e.select("label", F.posexplode("embedding").alias("d", "x"))
    mean = pe.groupBy("label", "d").agg(F.avg("x").alias("x"))
    vec = mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("_v"))
    v = F.transform("_v", lambda s: s["x"])
    from searchlane.operators.dense import l2_normalize
    return vec.select(F.col("label").cast("long").alias("query_id"), l2_normalize(v).alias("embedding"))
