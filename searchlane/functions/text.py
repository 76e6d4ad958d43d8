"""Text scalar functions as Spark Column builders (JVM-side, codegen'd).

Every function takes and returns ``Column`` so it composes inside one
whole-stage-codegen span; none of them needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ASCII punctuation removed by answer normalisation (the 32 characters of
# Python's string.punctuation, in natural order):
#   !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~
# Articles removed by answer normalisation: a, an, the
# Encoder prefixes: e5 query "query: ", e5 passage "passage: ",
# bge query "Represent this sentence for searching relevant passages: "
# Balance / quota error keywords:
#   insufficient, balance, arrear, quota, payment, bill, 余额, 欠费, 充值, 账户余额
# ---------------------------------------------------------------------------
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")
E5_QUERY_PREFIX = "query: "
E5_PASSAGE_PREFIX = "passage: "
BGE_QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
QUOTA_ERROR_KEYWORDS = ("insufficient", "balance", "arrear", "quota", "payment", "bill",
                        "余额", "欠费", "充值", "账户余额")

_PUNCT_CLASS = "[" + "".join("\\" + c for c in ASCII_PUNCTUATION) + "]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace.

    Spark's ``trim`` only removes the space character, so a regex is used.
    """
    return F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", "")


def normalize_answer(col) -> Column:
    """Lower -> drop ASCII punctuation -> articles to space -> collapse whitespace."""
    s = F.lower(_c(col))
    s = F.regexp_replace(s, _PUNCT_CLASS, "")
    s = F.regexp_replace(s, r"(?U)\b(?:a|an|the)\b", " ")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return strip(s)


def passage_title(col, strip_quotes: bool = False) -> Column:
    """title = first line of a passage; optionally strip surrounding quotes."""
    t = F.substring_index(_c(col), "\n", 1)
    if strip_quotes:
        t = F.regexp_replace(t, '^"+|"+$', "")
    return t


def passage_text(col) -> Column:
    """text = every line after the first (empty when there is no line break)."""
    c = _c(col)
    pos = F.instr(c, "\n")
    return F.when(pos > 0, c.substr(pos + 1, F.length(c))).otherwise(F.lit(""))


def make_passage(title, text) -> Column:
    """T4: ``"title"\\ntext`` passage contents."""
    return F.concat(F.lit('"'), _c(title), F.lit('"\n'), _c(text))


def encoder_input(col, model_name: str, is_query: bool, builder: bool = False) -> Column:
    """T5: encoder input prefixes.

    Retrieval path tests ``"e5" in name`` (and ``"bge"``), index building tests
    method equality ``== "e5"``; ``builder=True`` keeps that distinction.
    """
    name = model_name.lower()
    c = _c(col)
    if builder:
        if model_name == "e5" and not is_query:
            return F.concat(F.lit(E5_PASSAGE_PREFIX), c)
        return c
    if "e5" in name:
        c = F.concat(F.lit(E5_QUERY_PREFIX if is_query else E5_PASSAGE_PREFIX), c)
    if "bge" in name and is_query:
        c = F.concat(F.lit(BGE_QUERY_INSTRUCTION), c)
    return c


def sanitize_query(col) -> Column:
    """Non-word, non-space -> space; control whitespace -> space; collapse; strip."""
    s = F.regexp_replace(_c(col), r"(?U)[^\w\s]", " ")
    s = F.regexp_replace(s, "[\t\r\f\u000b\n]", " ")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return strip(s)


def parse_snippet(col) -> Column:
    """Split on ``...``; keep stripped segments of more than five words."""
    segs = F.transform(F.split(_c(col), r"\.\.\."), lambda s: strip(s))
    return F.filter(segs, lambda s: F.size(F.split(s, r"(?U)\s+")) > 5)


def convert_title_format(col) -> Column:
    """``(Title: t) text`` -> ``"t"\\ntext``; other text unchanged."""
    return F.regexp_replace(_c(col), r"(?s)^\(Title:\s*([^)]+)\)\s*(.+)$", '"$1"\n$2')


def pair_text(title, text) -> Column:
    """``(Title: t) text`` pair text for a cross-encoder."""
    return F.concat(F.lit("(Title: "), _c(title), F.lit(") "), _c(text))


def is_quota_error(col) -> Column:
    """Error message mentions a balance/quota keyword (case-insensitive)."""
    c = F.lower(_c(col))
    hit = F.lit(False)
    for kw in QUOTA_ERROR_KEYWORDS:
        hit = hit | F.contains(c, F.lit(kw))
    return F.coalesce(hit, F.lit(False))


def remove_pad(col, pad_token: str) -> Column:
    """Remove pad-token text from generated strings."""
    return F.replace(_c(col), F.lit(pad_token), F.lit(""))


def whitespace_tokens(col) -> Column:
    """Default tokenizer: whitespace-separated tokens (empty text -> empty array)."""
    s = strip(_c(col))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, r"(?U)\s+"))


def token_count(col) -> Column:
    return F.size(whitespace_tokens(col))


def truncate_tokens_text(col, n) -> Column:
    """A2: keep the first ``n`` whitespace tokens, re-joined with single spaces, stripped."""
    toks = whitespace_tokens(col)
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(toks) <= n, strip(_c(col))) \
        .otherwise(strip(F.array_join(F.slice(toks, 1, n), " ")))


def analyzer_terms(col) -> Column:
    """BM25 analyzer: lower-case letters/digits runs; no stemming, no stop list."""
    return F.array_remove(F.split(F.lower(_c(col)), r"[^\p{L}\p{N}]+"), "")
