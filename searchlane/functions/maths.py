"""Boxed answers of maths solutions and their normal form as column expressions.

The rules are the public conventions for MATH answers: spacing and sizing commands, units,
degree, dollar and escaped percent signs go; ``tfrac``/``dfrac`` read as ``frac``; bare
arguments of ``\\sqrt`` and ``\\frac`` get braces; a leading zero is added; a short
``x =`` prefix goes; ``0.5`` and ``a/b`` of two integers become fractions. Where those
rules can't read a string, its normal form is null and only equal strings are equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from searchlane.functions.text import _c

BOXED, SPACED = "\\boxed", "\\boxed "

# What the conventions delete or rewrite, in this order.
REPLACEMENTS = (
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
    ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
)
UNIT = "\\text{ "


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def _closed_group(rest: Column) -> Column:
    """Content of the brace group that ``rest`` starts with, or null if it never closes.

    The text is cut at its closing braces; after piece i the depth is one plus the opening
    braces so far less the closed ones."""
    pieces = F.split(F.substr(rest, F.lit(2)), "[}]")
    state = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        F.struct(F.lit(1.0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done")),
        lambda s, p: F.when(s["done"], s).otherwise(F.struct(
            (s["depth"] + _count(p, "{") - 1).alias("depth"), (s["n"] + 1).alias("n"),
            (s["depth"] + _count(p, "{") - 1 == 0).alias("done"))))
    return _let(state, lambda s: F.when(s["done"], F.array_join(F.slice(pieces, F.lit(1), s["n"]), "}")))


def boxed_answer(col) -> Column:
    """Content of the last ``\\boxed`` (``\\boxed x$`` up to the dollar sign, else the brace
    group); null without one."""
    c = _c(col)
    spaced = F.substring_index(F.substring_index(c, SPACED, -1), "$", 1)
    group = _let(F.substring_index(c, BOXED, -1),
                 lambda rest: F.when(F.startswith(rest, F.lit("{")), _closed_group(rest)))
    return F.when(F.contains(c, F.lit(SPACED)), spaced).when(F.contains(c, F.lit(BOXED)), group)


def _without_prefix(s: Column) -> Column:
    left = F.substring_index(s, "=", 1)
    return F.when((_count(s, "=") == 1) & (F.length(left) <= 2), F.substring_index(s, "=", -1)).otherwise(s)


def _braced_roots(s: Column) -> Column:
    return F.when(s.rlike(r"\\sqrt(\\sqrt|$)"), F.lit(None).cast("string")).otherwise(
        F.regexp_replace(s, r"\\sqrt([^{])", r"\\sqrt{$1}"))


def _braced_fractions(s: Column) -> Column:
    braced = F.regexp_replace(F.regexp_replace(s, r"\\frac([^{])\{", r"\\frac{$1}{"),
                              r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    return (F.when(s.rlike(r"\\frac(\\frac|$)"), F.lit(None).cast("string"))
            .when(s.rlike(r"\\frac[^{](\\frac|$)"), s).otherwise(braced))


def _slash_fraction(s: Column) -> Column:
    whole = r"-?(?:[1-9][0-9]*|0)"
    plain = s.rlike(f"^{whole}/{whole}$") & ~s.rlike(r"-0(/|$)")
    readable = s.rlike(r"^[+-]?[0-9]+(_[0-9]+)*/[+-]?[0-9]+(_[0-9]+)*$")
    return (F.when(_count(s, "/") != 1, s)
            .when(plain, F.regexp_replace(s, "^(.*)/(.*)$", r"\\frac{$1}{$2}"))
            .when(readable, s))


def normal_form(col) -> Column:
    """The normal form of an answer; null where the rules can't read it."""
    s = _c(col)
    for old, new in REPLACEMENTS:
        s = F.replace(s, F.lit(old), F.lit(new))
    s = _let(s, lambda x: F.when(_count(x, UNIT) <= 1, F.substring_index(x, UNIT, 1)))
    for old, new in (("\\%", ""), (" .", " 0."), ("{.", "{0.")):
        s = F.replace(s, F.lit(old), F.lit(new))
    s = _let(s, lambda x: F.when(F.startswith(x, F.lit(".")), F.concat(F.lit("0"), x)).otherwise(x))
    s = _let(_let(s, _without_prefix), _braced_roots)
    s = _let(F.replace(s, F.lit(" "), F.lit("")), _braced_fractions)
    s = _let(s, lambda x: F.when(x == "0.5", F.lit("\\frac{1}{2}")).otherwise(x))
    return _let(s, _slash_fraction)


def equivalent(answer: Column, truth: Column) -> Column:
    """Equal normal forms, or equal strings where either has none."""
    both = F.array(F.struct(normal_form(answer).alias("a"), normal_form(truth).alias("b")))
    same = F.element_at(F.transform(both, lambda p: F.coalesce(p["a"] == p["b"], answer == truth)), 1)
    return F.coalesce(same, F.lit(False))
