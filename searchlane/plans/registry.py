"""Query registry: every registered query is a (spark, sf_dir) -> DataFrame
callable plus, where SQL can express it, an equivalent DuckDB oracle string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# Shared SQL building blocks (DuckDB dialect) mirroring searchlane.sources.fixtures.
SQL_CORPUS = """corpus AS (
  SELECT doc_id AS id, '"' || source || '"' || chr(10) || text AS contents FROM documents)"""

SQL_TERMS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"

SQL_TITLE = "split_part({c}, chr(10), 1)"
SQL_TEXT = "CASE WHEN strpos({c}, chr(10)) > 0 THEN substr({c}, strpos({c}, chr(10)) + 1) ELSE '' END"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_normalize_answer(x: str) -> str:
    """DuckDB twin of functions.text.normalize_answer (Unicode-aware word boundary
    spelled out, because RE2's \\b is ASCII-only)."""
    s = f"regexp_replace(lower({x}), '[!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{{|}}~]', '', 'g')"
    art = "'(^|[^\\p{L}\\p{N}_])(a|an|the)([^\\p{L}\\p{N}_]|$)'"
    s = f"regexp_replace({s}, {art}, '\\1 \\3', 'g')"
    s = f"regexp_replace({s}, {art}, '\\1 \\3', 'g')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    return sql_strip(s)


SQL_BM25_HITS = """
dterms AS (SELECT id AS doc_id, {terms_c} AS terms FROM corpus),
doc_stats AS (SELECT doc_id, len(terms) AS doc_len FROM dterms),
postings AS (SELECT doc_id, term, count(*) AS tf
             FROM (SELECT doc_id, unnest(terms) AS term FROM dterms) GROUP BY doc_id, term),
qt AS (SELECT query_id, term, count(*) AS qtf
       FROM (SELECT query_id, unnest({terms_q}) AS term FROM q) GROUP BY query_id, term),
stats AS (SELECT count(*) AS n, avg(doc_len)::DOUBLE AS avgdl FROM doc_stats),
dft AS (SELECT term, count(*) AS df FROM postings WHERE term IN (SELECT term FROM qt) GROUP BY term),
scored AS (
  SELECT qt.query_id, p.doc_id,
         round(sum((qt.qtf * ln(1.0::DOUBLE + (s.n - dft.df + 0.5::DOUBLE) / (dft.df + 0.5::DOUBLE)))
                   * (p.tf * 1.9::DOUBLE
                      / (p.tf + 0.9::DOUBLE * (0.6::DOUBLE + 0.4::DOUBLE * ds.doc_len / s.avgdl)))), 6) AS score
  FROM qt JOIN postings p ON p.term = qt.term JOIN dft ON dft.term = qt.term
       JOIN doc_stats ds ON ds.doc_id = p.doc_id, stats s
  GROUP BY qt.query_id, p.doc_id),
hits AS (SELECT * FROM (
  SELECT query_id, doc_id, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM scored) WHERE rank <= {k})""".replace(
    "{terms_c}", SQL_TERMS.format(x="contents")).replace("{terms_q}", SQL_TERMS.format(x="query"))


def sql_lit(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10))."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def sql_strip_u(x: str) -> str:
    return sql_strip(x)


def sql_extract_answer(x: str, min_matches: int = 2) -> str:
    all_ = f"regexp_extract_all({x}, '(?s)<answer>(.*?)</answer>', 1)"
    return f"(CASE WHEN len({all_}) >= {min_matches} THEN {sql_strip(all_ + '[-1]')} END)"


def sql_em(pred: str, goldens: str) -> str:
    return (f"(len(list_filter({goldens}, lambda g: {sql_normalize_answer('g')} = "
            f"{sql_normalize_answer(pred)})) > 0)")


def sql_subem(pred: str, goldens: str) -> str:
    return (f"(len(list_filter({goldens}, lambda g: contains({sql_normalize_answer(pred)}, "
            f"{sql_normalize_answer('g')}))) > 0)")


def _sql_fixtures():
    from searchlane.sources.fixtures import DATA_SOURCES, PROMPT_HEAD, PROMPT_TAIL
    srcs = "[" + ", ".join(f"'{s}'" for s in DATA_SOURCES) + "]"
    nl = "chr(10)"
    responses = f"""responses AS (
  SELECT conv_id AS sample_id, turn AS turn_idx,
    CASE (conv_id + turn) % 5
      WHEN 0 THEN '<think>need to look this up</think>' || {nl} || '<search> ' || text || ' </search>'
      WHEN 1 THEN '<think>several lookups</think>' || {nl} || '<searches>' || {nl} || '<search>'
                  || replace(text, {nl}, '</search>' || {nl} || '<search>') || '</search>' || {nl} || '</searches>'
      WHEN 2 THEN '<think>I know it</think>' || {nl} || '<answer> ' || text || ' </answer>'
      WHEN 3 THEN '<ANSWER>' || text || '</ANSWER>'
      ELSE '<search>  </search> ' || text END AS response
  FROM conversations WHERE role = 'assistant')"""
    sequences = f"""sequences AS (
  SELECT row_id, data_source, prompt, response, prompt || response AS full_sequence, golden_answers FROM (
    SELECT p_partkey AS row_id, {srcs}[p_partkey % 7 + 1] AS data_source,
      {sql_lit(PROMPT_HEAD)} || 'What is the brand of part ' || p_partkey || '?' || {sql_lit(PROMPT_TAIL)} AS prompt,
      (CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '<think>I need the brand.</think>' || {nl} END)
      || '<search> brand of part ' || p_partkey || ' </search>' || {nl} || {nl} || '<information>'
      || (CASE WHEN p_partkey % 3 = 0 THEN 'Doc 1(Title: ' || p_name || ') unrelated text'
               ELSE 'Doc 1(Title: ' || p_name || ') The brand is ' || p_brand || '.' END)
      || '</information>' || {nl} || {nl} || '<think>found it</think>' || {nl}
      || (CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '<answer> '
               || (CASE WHEN p_partkey % 4 = 0 THEN 'Brand#00' ELSE p_brand END) || ' </answer>' END) AS response,
      [p_brand, p_name] AS golden_answers
    FROM part))"""
    ans = sql_extract_answer("full_sequence")
    rollout_log = f"""rollout_log AS (
  SELECT CASE WHEN row_id % 10 < 8 THEN 'train' ELSE 'test' END AS split, row_id AS "index",
         CASE WHEN row_id % 6 = 0 THEN NULL ELSE 'u' || row_id END AS uid,
         data_source, prompt, response, full_sequence, golden_answers,
         (CASE WHEN {ans} IS NULL THEN 0.0 WHEN {sql_em(ans, 'golden_answers')} THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
  FROM sequences)"""
    qa = f"""qa AS (
  SELECT p_partkey AS qid,
    CASE p_partkey % 3 WHEN 0 THEN 'What is the brand of part ' || p_partkey
                       WHEN 1 THEN 'What is the brand of part ' || p_partkey || '?'
                       ELSE '  What is the brand of part ' || p_partkey || ' ' END AS question,
    [p_brand, p_name] AS golden_answers
  FROM part)"""
    token_rows = """token_rows AS (
  SELECT g.row_id, o.o_custkey AS group_id, g.row_id % 50 AS batch_id, o.o_totalprice / 99991.0 AS score,
         g.responses, g.attention_mask, g.info_mask, g.old_log_probs, g.ref_log_prob, g."values"
  FROM (SELECT l_orderkey AS row_id,
               list(l_partkey ORDER BY l_linenumber, l_partkey, -(l_discount + 0.05), -(l_tax + 0.05), l_extendedprice / 99991.0, CASE WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN 0 ELSE 1 END) AS responses,
               list(1 ORDER BY l_linenumber, l_partkey, -(l_discount + 0.05), -(l_tax + 0.05), l_extendedprice / 99991.0, CASE WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN 0 ELSE 1 END) AS attention_mask,
               list(CASE WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN 0 ELSE 1 END ORDER BY l_linenumber, l_partkey, -(l_discount + 0.05), -(l_tax + 0.05), l_extendedprice / 99991.0, CASE WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN 0 ELSE 1 END) AS info_mask,
               list(-(l_discount + 0.05) ORDER BY l_linenumber, l_partkey, -(l_discount + 0.05), -(l_tax + 0.05), l_extendedprice / 99991.0, CASE WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN 0 ELSE 1 END) AS old_log_probs,
               list(-(l_tax + 0.05) ORDER BY l_linenumber, l_partkey, -(l_discount + 0.05), -(l_tax + 0.05), l_extendedprice / 99991.0, CASE WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN 0 ELSE 1 END) AS ref_log_prob,
               list(l_extendedprice / 99991.0 ORDER BY l_linenumber, l_partkey, -(l_discount + 0.05), -(l_tax + 0.05), l_extendedprice / 99991.0, CASE WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN 0 ELSE 1 END) AS "values"
        FROM lineitem GROUP BY l_orderkey) g
  JOIN orders o ON o.o_orderkey = g.row_id)"""
    return dict(responses=responses, sequences=sequences, rollout_log=rollout_log, qa=qa,
                token_rows=token_rows)


SQL_FX = _sql_fixtures()
