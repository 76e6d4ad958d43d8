"""Registered retrieval queries: BM25, observations, dense, rerank, RAG context."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlane.operators.bm25 import bm25_search, build_bm25
from searchlane.operators.common import spread
from searchlane.operators.observe import attach_docs, passages_to_string
from searchlane.plans.registry import (SQL_BM25_HITS, SQL_CORPUS, SQL_TERMS, SQL_TEXT, SQL_TITLE,
                                       register, sql_strip)
from searchlane.session import materialise
from searchlane.sources import fixtures as fx
from searchlane.sources.tables import Tables

TOPK = 3

_SQL_Q = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


@register("bm25_topk", sql=f"""
WITH {SQL_CORPUS}, {_SQL_Q}, {SQL_BM25_HITS.replace('{k}', str(TOPK))}
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM hits""")
def bm25_topk(spark, sf_dir):
    """V1+V2: index the whole corpus, top-3 for every benchmark text."""
    t = Tables(spark, sf_dir)
    idx = build_bm25(fx.corpus(t))
    return bm25_search(fx.queries(t), idx, k=TOPK).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search_observations(spark, sf_dir):
    """Flagship: documents -> passages -> BM25 index -> top-3 per benchmark
    query -> documents attached -> ``Doc i(Title: t) text`` observation block.
    Queries without any hit keep an empty observation."""
    t = Tables(spark, sf_dir)
    corpus = fx.corpus(t)
    qs = fx.queries(t)
    hits = bm25_search(qs, build_bm25(corpus), k=TOPK)
    docs = attach_docs(hits, corpus, queries=qs, k=TOPK)
    block = passages_to_string(docs, key="query_id")
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return (qs.select("query_id").join(block, "query_id", "left").join(n, "query_id", "left")
            .select("query_id", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"),
                    F.coalesce("result", F.lit("")).alias("observation")))


register("search_observations", sql=f"""
WITH {SQL_CORPUS}, {_SQL_Q}, {SQL_BM25_HITS.replace('{k}', str(TOPK))},
docs AS (SELECT h.query_id, h.rank, c.contents FROM hits h JOIN corpus c ON c.id = h.doc_id),
blk AS (SELECT query_id, count(*) AS n_hits,
               string_agg('Doc ' || rank || '(Title: ' || {SQL_TITLE.format(c='contents')} || ') '
                          || {SQL_TEXT.format(c='contents')} || chr(10), '' ORDER BY rank) AS result
        FROM docs GROUP BY query_id)
SELECT q.query_id, coalesce(b.n_hits, 0)::BIGINT AS n_hits, coalesce(b.result, '') AS observation
FROM q LEFT JOIN blk b ON b.query_id = q.query_id""")(search_observations)


# ---------------------------------------------------------------- dense (V5, V6)
DENSE_K = 10
_SQL_CENTROIDS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
dm AS (SELECT label, i, avg(v[i]) AS x FROM e, generate_series(1, len(v)) AS g(i) GROUP BY label, i),
c AS (SELECT label, list(x ORDER BY i) AS v FROM dm GROUP BY label),
cn AS (SELECT label, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS nrm FROM c),
qv AS (SELECT label::BIGINT AS query_id, list_transform(v, lambda y: y / nrm) AS q FROM cn)"""


@register("dense_topk", sql=f"""
WITH {_SQL_CENTROIDS},
s AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(q, v), 6) AS score FROM qv, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {DENSE_K}""")
def dense_topk(spark, sf_dir):
    """V5 + V6: label-centroid queries, exact inner-product top-10 over all vectors."""
    from searchlane.operators.dense import dense_search
    t = Tables(spark, sf_dir)
    q = fx.label_centroid_queries(t)
    return dense_search(q, t.embeddings, k=DENSE_K).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _sql_hashed(name: str, of: str, key: str, text: str) -> str:
    """Unit vectors of signed md5 buckets (64 of them, so the first byte names one), as (key, b, x)."""
    return f"""{name}_t AS (SELECT {key}, unnest({SQL_TERMS.format(x=text)}) AS t FROM {of}),
{name}_b AS (SELECT {key}, ('0x' || substr(md5(t), 1, 2))::INT % 64 AS b,
                    sum(CASE WHEN ('0x' || substr(md5(t), 10, 1))::INT % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS n
             FROM {name}_t GROUP BY ALL),
{name} AS (SELECT {key}, b, (n::FLOAT / sqrt(sum(n * n) OVER (PARTITION BY {key}))::FLOAT)::DOUBLE AS x FROM {name}_b)"""


@register("hashed_dense_search", sql=f"""
WITH {SQL_CORPUS}, {_SQL_Q},
{_sql_hashed('dv', 'corpus', 'id', "'passage: ' || contents")},
{_sql_hashed('qv', 'q', 'query_id', "'query: ' || query")},
s AS (SELECT q.query_id, c.id AS doc_id,
             round(coalesce((SELECT sum(qv.x * dv.x) FROM qv JOIN dv USING (b)
                             WHERE qv.query_id = q.query_id AND dv.id = c.id), 0), 6) AS score
      FROM q, corpus c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {TOPK}""")
def hashed_dense_search(spark, sf_dir):
    """V3, V8, T5: encode the corpus and the benchmark queries with the
    (pluggable) encoder, e5-style prefixes, dispatch by method name."""
    from searchlane.operators.bm25 import retrieve
    from searchlane.operators.dense import encode_texts
    t = Tables(spark, sf_dir)
    # written once: the search reads the vectors twice, to count them by length and to deal them
    vecs = materialise(encode_texts(spread(fx.corpus(t)), None, "id", "contents", is_query=False, model_name="e5-hash")
                       .withColumnRenamed("id", "doc_id"), "vectors")
    return retrieve(fx.queries(t), "e5-hash", k=TOPK, dense_index=vecs).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


@register("ivf_recall")
def ivf_recall(spark, sf_dir):
    """V7: k-means cells (Spark ML) + probed-cell exact search; recall@10 vs V6."""
    from searchlane.operators.dense import build_ivf, dense_search, ivf_search, recall_at_k
    t = Tables(spark, sf_dir)
    q = fx.label_centroid_queries(t)
    model = build_ivf(t.embeddings, n_cells=8)
    approx = ivf_search(q, t.embeddings, model, k=DENSE_K, n_probe=3)
    return recall_at_k(approx, dense_search(q, t.embeddings, k=DENSE_K))


@register("cell_index_recall", sql="""
SELECT count(DISTINCT label) AS n_queries, (10 * count(DISTINCT label))::BIGINT AS n_exact, true AS recall_reached
FROM embeddings""")
def cell_index_recall(spark, sf_dir):
    """V7: a stored cell index is built, its number of probes is set for a recall of 0.95 on a
    sample of its vectors, and it is searched; the row says whether the search returns at
    least nine tenths of the exact top-10 (V6)."""
    from searchlane.operators.dense import build_cell_index, cell_search, dense_search, probes_for_recall
    t = Tables(spark, sf_dir)
    q = fx.label_centroid_queries(t)
    index = build_cell_index(t.embeddings, n_cells=16)
    found = cell_search(q, index, k=DENSE_K, n_probe=probes_for_recall(index, DENSE_K, 0.95))
    exact = dense_search(q, t.embeddings, k=DENSE_K)
    hit = exact.join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_exact"),
                   (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


# ---------------------------------------------------------------- rerank
def _sql_terms_distinct(x):
    return f"list_distinct({SQL_TERMS.format(x=x)})"


_PAIR_SQL = ("'(Title: ' || regexp_replace(" + SQL_TITLE.format(c="contents") +
             ", '^\"+|\"+$', '', 'g') || ') ' || " + SQL_TEXT.format(c="contents"))


@register("rerank_top3", sql=f"""
WITH {SQL_CORPUS}, {_SQL_Q}, {SQL_BM25_HITS.replace('{k}', '10')},
cand AS (SELECT h.query_id, h.doc_id, q.query, {_PAIR_SQL} AS pair_text
         FROM hits h JOIN corpus c ON c.id = h.doc_id JOIN q ON q.query_id = h.query_id),
sc AS (SELECT *, round(len(list_intersect({_sql_terms_distinct('query')}, {_sql_terms_distinct('pair_text')}))::DOUBLE
                       / len({_sql_terms_distinct('query')}), 6) AS rerank_score FROM cand),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rerank_rank FROM sc)
SELECT query_id, rerank_rank::INTEGER AS rerank_rank, doc_id, rerank_score,
       md5(regexp_replace(pair_text, '(?s)^\\(Title:\\s*([^)]+)\\)\\s*(.+)$', '"\\1"' || chr(10) || '\\2')) AS document_md5
FROM rr WHERE rerank_rank <= 3""")
def rerank_top3(spark, sf_dir):
    """BM25 top-10 -> lexical cross-scorer -> top-3 -> title format back."""
    from searchlane.operators.retrieval_extras import retrieve_rerank
    t = Tables(spark, sf_dir)
    corpus = fx.corpus(t)
    rr = retrieve_rerank(fx.queries(t), corpus, build_bm25(corpus), 10, 3)
    return rr.select("query_id", F.col("rerank_rank").cast("int").alias("rerank_rank"), "doc_id",
                     "rerank_score", F.md5("document").alias("document_md5"))


# ---------------------------------------------------------------- RAG context
@register("rag_context", sql=f"""
WITH {SQL_CORPUS}, {_SQL_Q}, {SQL_BM25_HITS.replace('{k}', '5')},
docs AS (SELECT h.query_id, h.rank, c.contents FROM hits h JOIN corpus c ON c.id = h.doc_id WHERE h.rank <= 3),
ctx AS (SELECT query_id, string_agg('Doc ' || rank || '(Title: ' || {SQL_TITLE.format(c='contents')} || ') '
                 || {SQL_TEXT.format(c='contents')} || chr(10), '' ORDER BY rank) AS context FROM docs GROUP BY query_id)
SELECT q.query_id, md5(coalesce(ctx.context, '')) AS context_md5, length(coalesce(ctx.context, ''))::BIGINT AS context_chars
FROM q LEFT JOIN ctx ON ctx.query_id = q.query_id""")
def rag_context(spark, sf_dir):
    """A top-5 retrieval cache (ordered id lists) -> first 3 passages as context."""
    from searchlane.operators.retrieval_extras import add_context
    t = Tables(spark, sf_dir)
    corpus = fx.corpus(t)
    qs = fx.queries(t)
    hits = bm25_search(qs, build_bm25(corpus), k=5)
    cache = hits.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    out = add_context(qs, cache, corpus, 3, key="query_id")
    return out.select("query_id", F.md5("context").alias("context_md5"),
                      F.length("context").cast("long").alias("context_chars"))


# ---------------------------------------------------------------- pages
_SQL_PTEXT = ("array_to_string(list_transform(regexp_split_to_array(regexp_replace(html, "
              "'(?is)<script\\b.*?</script>|<style\\b.*?</style>', '', 'g'), '(?i)<p(?:\\s[^>]*)?>')[2:], "
              "lambda b: regexp_replace(regexp_replace(b, '(?is)</p\\s*>.*$|</body\\b.*$', ''), '<[^>]*>', '', 'g')), chr(10))")


@register("page_paragraphs", sql=f"""
SELECT page_id, md5({_SQL_PTEXT}) AS text_md5, length({_SQL_PTEXT})::BIGINT AS text_chars FROM pages""")
def page_paragraphs(spark, sf_dir):
    """Paragraph text per page, unclosed paragraphs included."""
    from searchlane.operators.retrieval_extras import page_text_regex
    p = Tables(spark, sf_dir).pages
    txt = page_text_regex("html")
    return p.select("page_id", F.md5(txt).alias("text_md5"), F.length(txt).cast("long").alias("text_chars"))


@register("page_paragraphs_parser", sql=f"""
SELECT page_id, length({_SQL_PTEXT})::BIGINT AS text_chars, len(string_split({_SQL_PTEXT}, chr(10)))::BIGINT AS n_paragraphs
FROM pages""")
def page_paragraphs_parser(spark, sf_dir):
    """Size and number of a page's paragraphs (unclosed <p> included) in the column form; the
    parser it replaces is the tests' reference."""
    from searchlane.operators.retrieval_extras import page_text_regex
    p = Tables(spark, sf_dir).pages.select("page_id", page_text_regex("html").alias("text"))
    return p.select("page_id", F.length("text").cast("long").alias("text_chars"),
                    F.size(F.split("text", "\n")).cast("long").alias("n_paragraphs"))


def _snippets(p):
    from searchlane.operators.retrieval_extras import page_text_regex
    txt = page_text_regex("html")
    # snippet = the page's paragraphs glued by ' ... ' (as a search engine shows them)
    return p.select("page_id", txt.alias("text"),
                    F.concat_ws(" ... ", F.split(txt, "\n")).alias("snippet"))


_SQL_SNIP = f"""pt AS (SELECT page_id, {_SQL_PTEXT} AS text FROM pages),
sn AS (SELECT page_id, text, array_to_string(string_split(text, chr(10)), ' ... ') AS snippet FROM pt),
seg AS (SELECT page_id, s.pos AS spos, s.seg FROM sn,
        LATERAL (SELECT unnest(list_filter(list_transform(string_split(snippet, '...'), lambda x: {sql_strip('x')}),
                                        lambda x: len(regexp_split_to_array(x, '\\s+')) > 5)) AS seg,
                        generate_subscripts(list_filter(list_transform(string_split(snippet, '...'), lambda x: {sql_strip('x')}),
                                        lambda x: len(regexp_split_to_array(x, '\\s+')) > 5), 1) AS pos) s),
m AS (SELECT seg.page_id, spos, seg, pt.text AS doc, strpos(replace(pt.text, chr(10), ' '), seg) AS p
      FROM seg JOIN pt ON pt.page_id = seg.page_id),
b AS (SELECT *, substr(doc, 1, greatest(p - 1, 0)) AS before FROM m WHERE p > 0),
e AS (SELECT *, length(before) - length(split_part(before, chr(10), -1)) AS sta,
             strpos(substr(doc, p + length(seg)), chr(10)) AS nl FROM b),
g AS (SELECT *, CASE WHEN sta > 0 THEN sta - 1 ELSE 0 END AS sta0,
             CASE WHEN nl = 0 THEN length(doc) ELSE p + length(seg) - 1 + nl - 1 END AS end0 FROM e),
hit AS (SELECT page_id, spos, {sql_strip('substr(doc, sta0 + 1, end0 - sta0)')} AS para FROM g),
para AS (SELECT page_id, para, min(spos) AS spos FROM hit GROUP BY page_id, para)"""


@register("snippet_context", sql=f"""
WITH {_SQL_SNIP}
SELECT page_id, md5(string_agg(para, chr(10) ORDER BY spos)) AS context_md5, count(*)::BIGINT AS n_paragraphs
FROM para GROUP BY page_id""")
def snippet_context(spark, sf_dir):
    """T15 + T16 + J6: snippet segments located in the same page's lines."""
    from searchlane.operators.retrieval_extras import collect_context
    s = _snippets(Tables(spark, sf_dir).pages)
    ctx = collect_context(s, s, key="page_id")
    return ctx.select("page_id", F.md5("context").alias("context_md5"),
                      (F.size(F.split("context", "\n"))).cast("long").alias("n_paragraphs"))


@register("link_filter", sql="""
WITH it AS (SELECT page_id, url AS link, CASE WHEN page_id % 7 = 0 THEN 'application/pdf' END AS mime FROM pages),
x AS (SELECT *, regexp_extract(regexp_extract(link, '([^/]*)$', 1), '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext FROM it)
SELECT page_id, link FROM x WHERE mime IS NULL AND ext IN ('', '.html', '.htm', '.shtml')""")
def link_filter(spark, sf_dir):
    """P15 with the reference's whole-URL extension rule."""
    from searchlane.operators.retrieval_extras import filter_links
    p = Tables(spark, sf_dir).pages
    items = p.select("page_id", F.col("url").alias("link"),
                     F.when(F.col("page_id") % 7 == 0, F.lit("application/pdf")).alias("mime"))
    return filter_links(items, whole_url=True).select("page_id", "link")


@register("nested_results", sql=f"""
WITH {SQL_CORPUS}, {_SQL_Q}, {SQL_BM25_HITS.replace('{k}', str(TOPK))}
SELECT q.query_id, count(h.doc_id)::BIGINT AS n_results,
       coalesce(string_agg(h.doc_id::VARCHAR || ':' || h.score::VARCHAR, ',' ORDER BY h.rank), '') AS ranked
FROM q LEFT JOIN hits h ON h.query_id = q.query_id GROUP BY q.query_id""")
def nested_results(spark, sf_dir):
    """One row per query (request order kept by query id), ordered
    ``{document{id, contents}, score}`` lists; empty lists survive."""
    from searchlane.operators.observe import nest_results
    t = Tables(spark, sf_dir)
    corpus = fx.corpus(t)
    qs = fx.queries(t)
    docs = attach_docs(bm25_search(qs, build_bm25(corpus), k=TOPK), corpus, queries=qs, k=TOPK)
    n = nest_results(qs, docs)
    ranked = F.array_join(F.transform("result", lambda e: F.concat(
        e["document"]["id"].cast("string"), F.lit(":"), e["score"].cast("string"))), ",")
    return n.select("query_id", F.size("result").cast("long").alias("n_results"), ranked.alias("ranked"))


@register("online_results", sql=f"""
WITH pt AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
                   array_to_string(string_split({_SQL_PTEXT}, chr(10)), ' ... ') AS snip FROM pages),
it AS (SELECT page_id, '"' || title || '"' || chr(10) || snip AS doc,
              '"' || title || '"' || chr(10) || CASE WHEN page_id % 3 = 0 THEN 'No snippet available.' ELSE snip END AS box,
              '"No title."' || chr(10) || 'No snippet available.' AS bare FROM pt)
SELECT page_id, (CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END + 3 + CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END)::BIGINT AS n_passages,
       md5((CASE WHEN page_id % 5 = 0 THEN box || chr(10) ELSE '' END)
           || doc || chr(10) || bare || chr(10) || doc
           || (CASE WHEN page_id % 2 = 0 THEN chr(10) || doc || chr(10) || bare ELSE '' END)) AS passages_md5
FROM it""")
def online_results(spark, sf_dir):
    """Search-engine JSON built per page (an answer box that holds an answer and
    sometimes a snippet, four organic results, two related questions) as passages: the
    box's snippet, the first k = 3 organic results, related questions; missing fields get
    defaults."""
    from searchlane.operators.retrieval_extras import normalize_serp, page_text_regex
    p = Tables(spark, sf_dir).pages
    snippet = F.concat_ws(" ... ", F.split(page_text_regex("html"), "\n"))
    title = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    none = F.lit(None).cast("string")
    whole = F.struct(title.alias("title"), snippet.alias("snippet"), F.col("url").alias("link"))
    bare = F.struct(none.alias("title"), none.alias("snippet"), F.col("url").alias("link"))
    js = F.to_json(F.struct(
        F.when(F.col("page_id") % 5 == 0, F.struct(
            title.alias("title"), F.lit("an answer").alias("answer"),
            F.when(F.col("page_id") % 3 != 0, snippet).alias("snippet"))).alias("answer_box"),
        F.array(whole, bare, whole, whole).alias("organic_results"),
        F.when(F.col("page_id") % 2 == 0, F.array(
            F.struct(title.alias("question"), snippet.alias("snippet")),
            F.struct(none.alias("question"), none.alias("snippet")))).alias("related_questions")))
    out = normalize_serp(p.select("page_id", js.alias("serp")), "serp", k=3)
    return out.select("page_id", F.size("passages").cast("long").alias("n_passages"),
                      F.md5(F.array_join("passages", "\n")).alias("passages_md5"))


_SQL_CSE = """it AS (SELECT regexp_extract(url, '/([a-z][a-z])/', 1) AS query_id, page_id AS pos,
                    regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
                    array_to_string(string_split({ptext}, chr(10)), ' ... ') AS snippet FROM pages),
c AS (SELECT *, coalesce(title, '') AS t,
             array_to_string(list_filter(list_transform(string_split(coalesce(snippet, ''), '...'), lambda x: {sx}),
                                         lambda x: len(regexp_split_to_array(x, '\\s+')) > 5), ' ') AS cx FROM it),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM c WHERE t <> '' OR cx <> '')"""


@register("cse_results", sql=f"""
WITH {_SQL_CSE.format(ptext=_SQL_PTEXT, sx=sql_strip('x'))}
SELECT query_id, pos, rank::INTEGER AS rank,
       md5('"' || CASE WHEN t = '' THEN 'No title.' ELSE t END || '"' || chr(10)
           || CASE WHEN cx = '' THEN 'No snippet available.' ELSE cx END) AS contents_md5
FROM k WHERE rank <= 3""")
def cse_results(spark, sf_dir):
    """Pages as search-engine items grouped by the URL's language path;
    snippet-only passages, empty items dropped, first 3 per query."""
    from searchlane.operators.retrieval_extras import normalize_cse, page_text_regex
    p = Tables(spark, sf_dir).pages
    items = p.select(F.regexp_extract("url", r"/([a-z][a-z])/", 1).alias("query_id"), F.col("page_id").alias("pos"),
                     F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"),
                     F.concat_ws(" ... ", F.split(page_text_regex("html"), "\n")).alias("snippet"))
    out = normalize_cse(items, 3)
    return out.select("query_id", "pos", F.col("rank").cast("int").alias("rank"),
                      F.md5("contents").alias("contents_md5"))


class Md5Scorer:
    """Deterministic stand-in for a cross-encoder: a share of 2^24 from the md5 of the pair."""

    def predict(self, pairs):
        import hashlib
        return [int(hashlib.md5(f"{q}\n{d}".encode()).hexdigest()[:6], 16) / 2 ** 24 for q, d in pairs]


@register("model_rerank", sql=f"""
WITH {SQL_CORPUS}, {_SQL_Q}, {SQL_BM25_HITS.replace('{k}', '10')},
cand AS (SELECT h.query_id, h.doc_id, q.query, {_PAIR_SQL} AS pair_text
         FROM hits h JOIN corpus c ON c.id = h.doc_id JOIN q ON q.query_id = h.query_id),
sc AS (SELECT *, ('0x' || substr(md5(query || chr(10) || pair_text), 1, 6))::INT / 16777216.0::DOUBLE AS rerank_score FROM cand),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rerank_rank FROM sc)
SELECT query_id, rerank_rank::INTEGER AS rerank_rank, doc_id, rerank_score FROM rr WHERE rerank_rank <= 3""")
def model_rerank(spark, sf_dir):
    """V12 + U3: BM25 top-10 reranked by a model loaded once a worker."""
    from searchlane.operators.retrieval_extras import retrieve_rerank
    t = Tables(spark, sf_dir)
    corpus = fx.corpus(t)
    rr = retrieve_rerank(fx.queries(t), corpus, build_bm25(corpus), 10, 3, scorer=Md5Scorer)
    return rr.select("query_id", F.col("rerank_rank").cast("int").alias("rerank_rank"), "doc_id", "rerank_score")


@register("nested_results_plain", sql=f"""
WITH {SQL_CORPUS}, {_SQL_Q}, {SQL_BM25_HITS.replace('{k}', str(TOPK))}
SELECT q.query_id, count(h.doc_id)::BIGINT AS n_results,
       coalesce(string_agg(h.doc_id::VARCHAR || ':' || md5(c.contents), ',' ORDER BY h.rank), '') AS ranked
FROM q LEFT JOIN hits h ON h.query_id = q.query_id LEFT JOIN corpus c ON c.id = h.doc_id GROUP BY q.query_id""")
def nested_results_plain(spark, sf_dir):
    """V10 without scores: ordered ``{document{id, contents}}`` lists."""
    from searchlane.operators.observe import nest_results
    t = Tables(spark, sf_dir)
    corpus, qs = fx.corpus(t), fx.queries(t)
    docs = attach_docs(bm25_search(qs, build_bm25(corpus), k=TOPK), corpus, queries=qs, k=TOPK)
    ranked = F.array_join(F.transform("result", lambda e: F.concat(
        e["document"]["id"].cast("string"), F.lit(":"), F.md5(e["document"]["contents"]))), ",")
    return nest_results(qs, docs, with_scores=False).select(
        "query_id", F.size("result").cast("long").alias("n_results"), ranked.alias("ranked"))


@register("link_filter_paths", sql="""
WITH it AS (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '?view=full.pdf' WHEN page_id % 3 = 1 THEN '/doc.html#top.pdf'
                                        ELSE '/paper.pdf' END AS link, CASE WHEN page_id % 7 = 0 THEN 'application/pdf' END AS mime FROM pages),
x AS (SELECT *, regexp_extract(regexp_extract(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1),
                               '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext FROM it)
SELECT page_id, link FROM x WHERE mime IS NULL AND ext IN ('', '.html', '.htm', '.shtml')""")
def link_filter_paths(spark, sf_dir):
    """P15 by its default rule: the extension of the URL's path, whatever its query or fragment."""
    from searchlane.operators.retrieval_extras import filter_links
    k = F.col("page_id")
    end = F.when(k % 3 == 0, "?view=full.pdf").when(k % 3 == 1, "/doc.html#top.pdf").otherwise("/paper.pdf")
    items = Tables(spark, sf_dir).pages.select("page_id", F.concat("url", end).alias("link"),
                                               F.when(k % 7 == 0, F.lit("application/pdf")).alias("mime"))
    return filter_links(items).select("page_id", "link")
