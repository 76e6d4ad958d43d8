"""Agent action / tag parsing as Column expressions.

The earliest of ``<searches>``, ``<search>``, ``<answer>`` wins. One
alternation regex gives that directly: the leftmost match of an alternation is
the minimum over its branches' first matches, and the three opening tags can
never start at the same offset.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from searchlane.functions.text import _c, strip

# Recognised tags of the format checker and the assistant marker.
FORMAT_TAGS = ("think", "search", "information", "answer")
ASSISTANT_MARKER = "<|im_start|>assistant"


def _flags(ignore_case: bool) -> str:
    return "(?is)" if ignore_case else "(?s)"


def _action_re(ignore_case: bool) -> str:
    return (_flags(ignore_case)
            + r"<searches>(.*?)</searches>|<search>(.*?)</search>|<answer>(.*?)</answer>")


def parse_action(col, ignore_case: bool = False) -> Column:
    """``struct<action, queries, answer>``.

    action: ``search`` | ``answer`` | null (invalid). An empty ``<search>`` or a
    ``<searches>`` without non-empty inner ``<search>`` is invalid.
    """
    c = _c(col)
    rx = _action_re(ignore_case)
    block = F.regexp_extract(c, rx, 0)
    g_multi = F.regexp_extract(c, rx, 1)
    g_single = F.regexp_extract(c, rx, 2)
    g_answer = F.regexp_extract(c, rx, 3)
    low = F.lower(block)
    kind = (F.when(block == "", F.lit(None))
            .when(low.startswith("<searches>"), F.lit("searches"))
            .when(low.startswith("<search>"), F.lit("search"))
            .otherwise(F.lit("answer")))
    inner = F.regexp_extract_all(g_multi, F.lit(_flags(ignore_case) + r"<search>(.*?)</search>"), 1)
    multi_q = F.filter(F.transform(inner, lambda q: strip(q)), lambda q: q != "")
    single_q = strip(g_single)
    queries = (F.when(kind == "searches", multi_q)
               .when((kind == "search") & (single_q != ""), F.array(single_q))
               .otherwise(F.array().cast("array<string>")))
    action = (F.when(kind == "answer", F.lit("answer"))
              .when(kind.isin("search", "searches") & (F.size(queries) > 0), F.lit("search")))
    answer = F.when(kind == "answer", strip(g_answer))
    return F.struct(action.alias("action"), queries.alias("queries"), answer.alias("answer"))


def first_action_block(col, ignore_case: bool = False) -> Column:
    """The first action block itself, else the original text (quirk kept:
    any text before the block is dropped)."""
    c = _c(col)
    block = F.regexp_extract(c, _action_re(ignore_case), 0)
    return F.when(block == "", c).otherwise(block)


def extract_answer(col, min_matches: int = 2) -> Column:
    """Last ``<answer>`` content, stripped; null unless at least
    ``min_matches`` pairs (the prompt itself carries one example)."""
    found = F.regexp_extract_all(_c(col), F.lit(r"(?s)<answer>(.*?)</answer>"), 1)
    return F.when(F.size(found) >= min_matches, strip(F.element_at(found, -1)))


def last_query(col) -> Column:
    """Last ``<search>`` content (null when none)."""
    found = F.regexp_extract_all(_c(col), F.lit(r"(?s)<search>(.*?)</search>"), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def information_blocks(col) -> Column:
    """Every ``<information>`` block, stripped."""
    found = F.regexp_extract_all(_c(col), F.lit(r"(?s)<information>(.*?)</information>"), 1)
    return F.transform(found, lambda x: strip(x))


def tag_balance(col) -> Column:
    """opening/closing counts per tag and whether all are balanced."""
    c = _c(col)
    fields = []
    ok = F.lit(True)
    for t in FORMAT_TAGS:
        o = F.regexp_count(c, F.lit(f"<{t}>"))
        cl = F.regexp_count(c, F.lit(f"</{t}>"))
        fields += [o.alias(f"{t}_open"), cl.alias(f"{t}_close")]
        ok = ok & (o == cl)
    return F.struct(*fields, ok.alias("balanced"))


def _after_marker(c: Column) -> Column:
    pos = F.instr(c, ASSISTANT_MARKER)
    return F.when(pos > 0, c.substr(pos + len(ASSISTANT_MARKER), F.length(c)))


def tag_skeleton(col) -> Column:
    """Reduce text after the assistant marker to a tag skeleton.

    Tags become single letters (``<think>``=a ``</think>``=b ``<search>``=c
    ``</search>``=d ``<information>``=e ``</information>``=f ``<answer>``=g
    ``</answer>``=h); whitespace vanishes; every other run of characters becomes
    ``x``. Only linear character-class regexes are used, so the cost is linear
    in the text (no backtracking over long responses).
    """
    s = _after_marker(_c(col))
    # private-use sentinels stand for tags; any such character already present is content
    s = F.regexp_replace(s, "[\uE000-\uE007]", "x")
    for i, t in enumerate(FORMAT_TAGS):
        s = F.replace(s, F.lit(f"<{t}>"), F.lit(chr(0xE000 + 2 * i)))
        s = F.replace(s, F.lit(f"</{t}>"), F.lit(chr(0xE001 + 2 * i)))
    s = F.regexp_replace(s, r"(?U)\s+", "")
    s = F.regexp_replace(s, "[^\uE000-\uE007]+", "x")
    s = F.translate(s, "".join(chr(0xE000 + i) for i in range(8)), "abcdefgh")
    return s


# start: <think> ... </think> then (<search>..</search><information>..</information>
# <think>..</think>)* then <answer>..</answer>, nothing but whitespace between tags.
_VALID_SKELETON = r"^ax?b(?:cx?dex?fax?b)*gx?h$"


def valid_sequence(col) -> Column:
    """T13 flag: the think -> (search -> information -> think)* -> answer machine
    over the text after the assistant marker; a missing marker is invalid."""
    sk = tag_skeleton(col)
    return F.coalesce(sk.rlike(_VALID_SKELETON), F.lit(False))


def valid_sequence_reason(col) -> Column:
    """T13 reason (coarse, JVM-side): why a sequence is rejected."""
    c = _c(col)
    bal = tag_balance(_after_marker(c))
    return (F.when(F.instr(c, ASSISTANT_MARKER) == 0, F.lit("Missing assistant marker"))
            .when(~bal["balanced"], F.lit("Mismatched tags"))
            .when(valid_sequence(c), F.lit("Valid sequence format"))
            .otherwise(F.lit("Unexpected tag or content order")))


def retrieval_correct(col, goldens) -> Column:
    """A normalised golden answer is contained in a normalised
    ``<information>`` block."""
    from searchlane.functions.text import normalize_answer
    blocks = F.transform(information_blocks(col), lambda b: normalize_answer(b))
    golds = F.transform(_c(goldens), lambda g: normalize_answer(g))
    return F.exists(blocks, lambda b: F.exists(golds, lambda g: F.contains(b, g)))


# The format checker's reason messages (formats must match).
#   "Missing assistant marker"
#   "Mismatch in {tag} tags: {opening} opening vs {closing} closing tags"
#   "Unexpected tag {tag} in state {state}"
#   "Unexpected content '{content}' between tags (state: {state})"
#   "Unexpected content in state {state}"
#   "Incomplete sequence, ended in state {state}"
#   "Valid sequence format"
_MOVES = {
    ("start", "<think>"): "in_think", ("information", "<think>"): "in_think",
    ("in_think", "</think>"): "after_think",
    ("after_think", "<search>"): "in_search", ("in_search", "</search>"): "after_search",
    ("after_search", "<information>"): "in_information",
    ("in_information", "</information>"): "information",
    ("after_think", "<answer>"): "in_answer", ("in_answer", "</answer>"): "end",
}
_INSIDE = {"in_think", "in_search", "in_information", "in_answer"}
_BETWEEN = {"start", "after_think", "after_search", "information"}


def _format_reason(text):
    import re
    if text is None:
        return None
    m = re.search(r"<\|im_start\|>assistant\s*", text)
    if not m:
        return "Missing assistant marker"
    body = text[m.end():]
    for t in FORMAT_TAGS:
        o, c = body.count(f"<{t}>"), body.count(f"</{t}>")
        if o != c:
            return f"Mismatch in {t} tags: {o} opening vs {c} closing tags"
    state = "start"
    for piece in re.split(r"(</?(?:think|search|information|answer)>)", body):
        if not piece.strip():
            continue
        if piece.startswith("<") and piece.endswith(">") and piece.strip("</>") in FORMAT_TAGS \
                and re.fullmatch(r"</?(?:think|search|information|answer)>", piece):
            nxt = _MOVES.get((state, piece))
            if nxt is None:
                return f"Unexpected tag {piece} in state {state}"
            state = nxt
        elif state in _BETWEEN:
            return f"Unexpected content '{piece.strip()}' between tags (state: {state})"
        elif state not in _INSIDE:
            return f"Unexpected content in state {state}"
    return "Valid sequence format" if state == "end" else f"Incomplete sequence, ended in state {state}"


def format_reason(col) -> Column:
    """T13 reason, exact: Arrow-batched pandas UDF walking the tag/content
    pieces through the transition table above (one small helper per row)."""
    @F.pandas_udf("string")
    def reason(s: pd.Series) -> pd.Series:
        return s.map(_format_reason)

    return reason(_c(col))
