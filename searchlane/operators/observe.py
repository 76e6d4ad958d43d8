"""Hits -> documents -> observation strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlane.functions.text import (passage_text, passage_title, strip,
                                       truncate_tokens_text)
from searchlane.operators.common import bounded_broadcast, spread

# Fixed value: hint returned for an invalid action.
INVALID_ACTION_HINT = (
    "\nMy previous action is invalid. "
    "If I want to search, I should put the query between <search> and </search>. "
    "If I want to launch parallel searches, I should put them inside <searches> ... </searches> "
    "with one or more <search> blocks. "
    "If I want to give the final answer, I should put the answer between <answer> and </answer>. "
    "Let me try again.\n"
)


def attach_docs(hits: DataFrame, corpus: DataFrame, id_col: str = "id",
                contents_col: str = "contents", queries: DataFrame | None = None,
                k: int = 1) -> DataFrame:
    """Equi-join hits to passages by the real document id.

    Hits are at most |queries| x k rows, so they are the broadcast side while
    the corpus streams through unshuffled (but for a corpus of fewer splits than cores); the bound is proven on the (cheap)
    query table when it is given, else on the hits themselves.
    """
    docs = spread(corpus.select(F.col(id_col).alias("doc_id"), F.col(contents_col).alias("contents")))
    return docs.join(bounded_broadcast(hits, proxy=queries, per_row=k), "doc_id")


def passage_line(rank_col: str = "rank", contents_col: str = "contents"):
    """A1 element: ``Doc i(Title: t) text\\n``."""
    c = F.col(contents_col)
    return F.concat(F.lit("Doc "), F.col(rank_col).cast("string"), F.lit("(Title: "),
                    passage_title(c), F.lit(") "), passage_text(c), F.lit("\n"))


def passages_to_string(docs: DataFrame, key: str = "query_id", rank_col: str = "rank",
                       max_tokens: int | None = None) -> DataFrame:
    """A1: ordered per-key passage block. Groups hold k rows (bounded). With ``max_tokens``
    a block that will be cut to so many tokens: a line is cut behind one token more before it
    is sent, so that the cut block is the same and whole documents aren't moved for it."""
    lines = docs.withColumn("_line", passage_line(rank_col))
    if max_tokens is not None:
        # a line starts with a token; its last part is the rest beyond max_tokens + 1 tokens
        parts = F.col("_parts")
        lines = lines.withColumn("_parts", F.split("_line", r"(?U)\s+", max_tokens + 2)).withColumn(
            "_line", F.when(F.size(parts) == max_tokens + 2,
                            F.concat(F.array_join(F.slice(parts, 1, max_tokens + 1), " "), F.lit("\n"))).otherwise(F.col("_line")))
    lines = lines.select(key, F.struct(F.col(rank_col).alias("r"), F.col("_line").alias("line")).alias("e"))
    return (lines.groupBy(key)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["line"]), "")
                 .alias("result")))


def truncate_result(col, max_obs_tokens: int):
    """A2: cap a search result to ``max_obs_tokens`` tokens (whitespace tokenizer by
    default), stripped."""
    return truncate_tokens_text(col, max_obs_tokens)


def nest_results(queries: DataFrame, docs: DataFrame, with_scores: bool = True,
                 query_id: str = "query_id") -> DataFrame:
    """One row per query in request order, ``result`` = ordered array of
    ``{document{id, contents}, score}``; queries with no hit keep an empty list."""
    el = {"rank": F.col("rank"),
          "document": F.struct(F.col("doc_id").alias("id"), F.col("contents"))}
    if with_scores:
        el["score"] = F.col("score")
    nested = (docs.groupBy(query_id)
              .agg(F.array_sort(F.collect_list(F.struct(*[v.alias(k) for k, v in el.items()])))
                   .alias("result")))
    return (queries.join(nested, query_id, "left")
            .withColumn("result", F.coalesce("result", F.array().cast(nested.schema["result"].dataType))))


def format_observation(per_query: DataFrame, key: str, pos_col: str = "qpos",
                       query_col: str = "query", result_col: str = "result") -> DataFrame:
    """Regroup per-query results to their sample.

    One query -> its stripped result; several -> ``[Search i] Query: q\\nresult``
    sections joined by a blank line. Input has one row per (key, query position).
    """
    sec = F.struct(F.col(pos_col).alias("p"), F.col(query_col).alias("q"),
                   F.col(result_col).alias("r"))
    g = per_query.groupBy(key).agg(F.array_sort(F.collect_list(sec)).alias("_s"))
    multi = F.array_join(F.transform(
        "_s", lambda s: strip(F.concat(F.lit("[Search "), (s["p"] + 1).cast("string"),
                                       F.lit("] Query: "), s["q"], F.lit("\n"), strip(s["r"])))),
        "\n\n")
    obs = F.when(F.size("_s") == 1, strip(F.col("_s")[0]["r"])).otherwise(strip(multi))
    return g.select(key, obs.alias("observation"))


def information_block(obs_col) -> F.Column:
    """Search observation wrapper appended to the rolling context."""
    return F.concat(F.lit("\n\n<information>"), obs_col, F.lit("</information>\n\n"))
