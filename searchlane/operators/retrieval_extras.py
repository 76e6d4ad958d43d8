"""Rerank, two-stage retrieval, RAG context, query cache and online-search
result shaping (V10-V18, T15-T17, P15)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchlane.functions.text import (_c, analyzer_terms, convert_title_format, pair_text,
                                       parse_snippet, passage_text, passage_title, strip)
from searchlane.operators.common import bounded_broadcast, object_key, top_k, worker_object
from searchlane.operators.observe import attach_docs, passage_line
from searchlane.session import materialise

SCORE_DIGITS = 6


# ------------------------------------------------------------------ V12-V14
def lexical_overlap(query, doc) -> Column:
    """Default JVM-side scorer: share of distinct query terms found in the doc."""
    q = F.array_distinct(analyzer_terms(query))
    d = F.array_distinct(analyzer_terms(doc))
    return F.round(F.try_divide(F.size(F.array_intersect(q, d)).cast("double"),
                                F.size(q).cast("double")), SCORE_DIGITS)


def model_scores(pairs: DataFrame, scorer_factory: Callable, query_col: str = "query",
                 doc_col: str = "pair_text", batch_size: int = 64) -> DataFrame:
    """Pluggable cross-encoder: ``scorer.predict(list[(q, d)]) -> list[float]`` on batches that
    Spark forms; only the two texts go to Python, and the model is loaded once per worker
    (``predict_batch_udf``). A null text is scored as an empty one."""
    from pyspark.ml.functions import predict_batch_udf
    key = object_key(scorer_factory)

    def make():
        model = worker_object(key, scorer_factory)
        return lambda queries, docs: np.asarray(model.predict(list(zip(queries, docs))), np.float64)

    score = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=batch_size)
    return pairs.withColumn("rerank_score", score(F.coalesce(F.col(query_col), F.lit("")), F.coalesce(F.col(doc_col), F.lit(""))))


def rerank(candidates: DataFrame, k: int, scorer: Callable | None = None,
           query_id: str = "query_id", query_col: str = "query") -> DataFrame:
    """Score each (query, own candidate) pair, keep the top ``k`` by score
    desc (doc id asc on ties). Candidates carry ``contents``."""
    pairs = candidates.withColumn(
        "pair_text", pair_text(passage_title("contents", strip_quotes=True), passage_text("contents")))
    if scorer is None:
        scored = pairs.withColumn("rerank_score", lexical_overlap(query_col, "pair_text"))
    else:
        scored = model_scores(pairs, scorer, query_col, "pair_text")
    return top_k(scored, [query_id], [F.col("rerank_score").desc(), F.col("doc_id").asc()], k,
                 rank_col="rerank_rank")


def retrieve_rerank(queries: DataFrame, corpus: DataFrame, index, k_retrieve: int = 10,
                    k_rerank: int = 3, scorer: Callable | None = None) -> DataFrame:
    """BM25 top-10 -> rerank -> top-3, documents converted back from the
    ``(Title: t) text`` pair form to ``"t"\\ntext``."""
    from searchlane.operators.bm25 import bm25_search
    hits = bm25_search(queries, index, k_retrieve)
    cand = attach_docs(hits, corpus, queries=queries, k=k_retrieve).join(queries, "query_id")
    rr = rerank(cand, k_rerank, scorer)
    return rr.withColumn("document", convert_title_format("pair_text"))


# ------------------------------------------------------------------ V17
def add_context(qa: DataFrame, cache: DataFrame, corpus: DataFrame, k: int,
                key: str = "question", ids_col: str = "doc_ids") -> DataFrame:
    """``context`` = ``Doc i(Title: t) text\\n`` for the first k cached ids
    of each question, in cache order (equi-join on id, ordered regroup)."""
    ex = cache.select(key, F.posexplode(F.slice(ids_col, 1, k)).alias("pos", "doc_id"))
    # the bound follows from the (cheap) questions: at most k ids of each; the cache, often a
    # search, is not run for it
    ex = ex.join(qa.select(key).distinct(), key, "left_semi")
    docs = attach_docs(ex.withColumn("rank", F.col("pos") + 1), corpus, queries=qa, k=k)
    ctx = (docs.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", passage_line().alias("line")))),
        lambda x: x["line"]), "").alias("context")))
    return qa.join(ctx, key, "left").withColumn("context", F.coalesce("context", F.lit("")))


# ------------------------------------------------------------------ V11 / W13
def distinct_first_seen(requests: DataFrame, query_col: str = "query",
                        order_cols: tuple[str, ...] = ("sample_id", "qpos")) -> DataFrame:
    """Distinct queries with the position of their first occurrence and the number
    of requests (one partial aggregate, no global sort)."""
    first = F.min(F.struct(*[F.col(c) for c in order_cols]))
    return requests.groupBy(query_col).agg(first.alias("first_seen"), F.count(F.lit(1)).alias("n_requests"))


def retrieve_cached(requests: DataFrame, cache: DataFrame | None, retrieve_fn: Callable,
                    step: int, query_col: str = "query", capacity: int | None = None):
    """Dedupe request queries, reuse cached results, retrieve only misses,
    then refresh ``last_used`` and evict the least recently used beyond
    ``capacity``. Returns (per-request results, new cache).

    The cache is a table (query, rank, doc_id, score, last_used)."""
    uniq = requests.select(query_col).distinct()
    if cache is None:
        misses = uniq
    else:
        misses = uniq.join(cache.select(query_col).distinct(), query_col, "left_anti")
    # written once: the answers and the returned cache read it, and later steps search no more
    fresh = materialise(retrieve_fn(misses).withColumn("last_used", F.lit(step).cast("long")), "cache_fresh")
    if cache is None:
        merged = fresh
    else:
        used = uniq.withColumn("_hit", F.lit(True))
        old = (cache.join(used, query_col, "left")
               .withColumn("last_used", F.when(F.col("_hit"), F.lit(step).cast("long"))
                           .otherwise(F.col("last_used"))).drop("_hit"))
        merged = old.unionByName(fresh)
    # this step's answers come from everything known now; eviction only bounds what is kept
    results = requests.join(merged.drop("last_used"), query_col, "left")
    if capacity is not None:
        recency = merged.groupBy(query_col).agg(F.max("last_used").alias("_lu"))
        # LRU capacity is the feature: a global top-N (per-partition top-N, then merge)
        keep = recency.orderBy(F.col("_lu").desc(), F.col(query_col)).limit(capacity)
        merged = merged.join(keep.select(query_col), query_col, "left_semi")
    return results, merged if cache is None and capacity is None else materialise(merged, "result_cache")


# ------------------------------------------------------------------ V15 / V16
SERP_SCHEMA = ("struct<answer_box: struct<title: string, snippet: string>, "
               "organic_results: array<struct<title: string, snippet: string, link: string>>, "
               "related_questions: array<struct<question: string, snippet: string>>>")


def normalize_serp(df: DataFrame, json_col: str, k: int) -> DataFrame:
    """Answer box + top-k organic + top-k related questions as passages,
    with defaults for missing title/snippet."""
    j = F.from_json(F.col(json_col), SERP_SCHEMA)
    box = F.when(j["answer_box"].isNotNull(), F.array(F.struct(
        F.coalesce(j["answer_box"]["title"], F.lit("No title.")).alias("title"),
        F.coalesce(j["answer_box"]["snippet"], F.lit("No snippet available.")).alias("text")))).otherwise(F.array())
    org = F.transform(F.slice(F.coalesce(j["organic_results"], F.array()), 1, k), lambda r: F.struct(
        F.coalesce(r["title"], F.lit("No title.")).alias("title"),
        F.coalesce(r["snippet"], F.lit("No snippet available.")).alias("text")))
    rel = F.transform(F.slice(F.coalesce(j["related_questions"], F.array()), 1, k), lambda r: F.struct(
        F.coalesce(r["question"], F.lit("No title.")).alias("title"),
        F.coalesce(r["snippet"], F.lit("No snippet available.")).alias("text")))
    return df.withColumn("passages", F.transform(
        F.concat(box.cast("array<struct<title:string,text:string>>"), org, rel),
        lambda p: F.concat(F.lit('"'), p["title"], F.lit('"\n'), p["text"])))


def filter_links(items: DataFrame, link_col: str = "link", mime_col: str = "mime",
                 whole_url: bool = False) -> DataFrame:
    """Drop items with a mime type; keep extension in {'', .html, .htm,
    .shtml}. ``whole_url=True`` applies the extension rule to the whole URL
    string (reference behaviour), otherwise to the URL path."""
    # the path as RFC 3986 cuts it, also of a URL that is not valid otherwise
    path = F.regexp_extract(link_col, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)
    src = F.col(link_col) if whole_url else F.coalesce(path, F.lit(""))
    base = F.regexp_extract(src, r"([^/]*)$", 1)
    ext = F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)$", 1)
    return items.filter(F.col(mime_col).isNull() & ext.isin("", ".html", ".htm", ".shtml"))


def collect_context(snippets: DataFrame, pages_text: DataFrame, key: str = "page_id",
                    snippet_col: str = "snippet", text_col: str = "text") -> DataFrame:
    """Every snippet segment of more than five words is located in the
    page of the *same key* (newlines read as spaces while searching), widened
    to the enclosing line bounds, stripped, kept once in segment order and
    newline-joined. One row per segment: the page text is an equi-joined
    column and the search is ``instr``, so no (segment, line) pairs exist."""
    seg = snippets.select(key, F.posexplode(parse_snippet(snippet_col)).alias("spos", "seg"))
    j = seg.join(pages_text.select(key, F.col(text_col).alias("_doc")), key)
    doc = F.col("_doc")
    pos = F.instr(F.replace(doc, F.lit("\n"), F.lit(" ")), F.col("seg"))      # 1-based, 0 = absent
    before = F.expr("substring(_doc, 1, greatest(_pos - 1, 0))")
    # 0-based index of the last newline before the match (0 when none)
    sta = F.length(before) - F.length(F.substring_index(before, "\n", -1))
    sta0 = F.when(sta > 0, sta - 1).otherwise(F.lit(0))
    after_start = F.col("_pos") + F.length("seg")                             # 1-based first char after
    nl = F.instr(F.expr("substring(_doc, _pos + length(seg))"), F.lit("\n"))
    end0 = F.when(nl == 0, F.length(doc)).otherwise(after_start - 1 + nl - 1)  # 0-based exclusive end
    para = strip(F.expr("substring(_doc, _sta0 + 1, _end0 - _sta0)"))
    hit = (j.withColumn("_pos", pos).filter(F.col("_pos") > 0)
           .withColumn("_sta0", sta0).withColumn("_end0", end0)
           .select(key, "spos", para.alias("para")))
    first_pos = hit.groupBy(key, "para").agg(F.min("spos").alias("spos"))
    return (first_pos.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("spos", "para"))), lambda x: x["para"]), "\n").alias("context")))


# ------------------------------------------------------------------ T17
def _p_texts(html: str) -> str:
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.depth, self.buf, self.skip = [], 0, [], 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.skip += 1
            if tag == "p":
                if self.depth:
                    self.out.append("".join(self.buf))
                    self.buf = []
                self.depth = 1

        def handle_endtag(self, tag):
            if tag in ("script", "style") and self.skip:
                self.skip -= 1
            if tag == "p" and self.depth:
                self.out.append("".join(self.buf))
                self.buf, self.depth = [], 0

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.buf.append(data)

    p = P()
    p.feed(html or "")
    p.close()
    if p.depth:
        p.out.append("".join(p.buf))
    return "\n".join(p.out)


def page_text(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """Text of every ``<p>`` (tolerant parser: unclosed ``<p>`` ends at the
    next ``<p>``), newline-joined, in Arrow batches."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({key: pdf[key].values, "text": [_p_texts(h) for h in pdf[html_col]]})

    return pages.select(key, html_col).mapInPandas(run, f"{key} long, text string")


def page_text_regex(html) -> Column:
    """T17 as column expressions (oracle-checkable): the text of every ``<p>`` outside
    scripts and styles, tags stripped, newline-joined. A paragraph ends at ``</p>``, at
    the next ``<p>``, at the end of the body or with the page, so unclosed ones stay."""
    no_script = F.regexp_replace(_c(html), r"(?is)<script\b.*?</script>|<style\b.*?</style>", "")
    split = F.split(no_script, r"(?i)<p(?:\s[^>]*)?>")
    pieces = F.slice(split, F.lit(2), F.size(split) - 1)
    texts = F.transform(pieces, lambda b: F.regexp_replace(
        F.regexp_replace(b, r"(?is)</p\s*>.*$|</body\b.*$", ""), "<[^>]*>", ""))
    return F.array_join(texts, "\n")


def normalize_cse(items: DataFrame, k: int, key: str = "query_id", pos_col: str = "pos",
                  title_col: str = "title", snippet_col: str = "snippet") -> DataFrame:
    """Snippet-only results: context = kept snippet segments joined by a
    space; an item is dropped when title and context are both empty; missing
    ones get defaults; the first k surviving items per query (by position)."""
    from searchlane.operators.common import top_k as _top_k
    title = F.coalesce(F.col(title_col), F.lit(""))
    ctx = F.array_join(parse_snippet(F.coalesce(F.col(snippet_col), F.lit(""))), " ")
    kept = (items.select(key, pos_col, title.alias("_t"), ctx.alias("_c"))
            .filter((F.col("_t") != "") | (F.col("_c") != "")))
    doc = F.concat(F.lit('"'), F.when(F.col("_t") == "", F.lit("No title.")).otherwise(F.col("_t")),
                   F.lit('"\n'), F.when(F.col("_c") == "", F.lit("No snippet available.")).otherwise(F.col("_c")))
    out = kept.withColumn("contents", doc)
    return _top_k(out, [key], [F.col(pos_col).asc()], k).drop("_t", "_c")
