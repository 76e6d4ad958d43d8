"""Quality by a sparse rule ensemble.

Shallow boosted trees over text statistics are grown on a bounded sample of labelled
training documents (``PER_CLASS`` a class, a documented parameter). Every path from a root
is a conjunctive rule; a lasso-penalised logistic regression weighs the rules and drops
most of them; what is left is compiled into one Spark column expression. Statistics and
rules are plain columns, so that scoring is one scan without Python or shuffle.

Defined cases: null and empty texts have the statistics 0 and get the score the rules give
them; a null id is never held out; repeated rows give one row each; without labels of both
classes every score is the share of class 1 (0.5 without labels); an empty table gives an
empty result; columns beside doc_id and text aren't read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlane.llm.labels import held_out, training_sample
from searchlane.llm.textkit import SPACES

FOLDS, HELD_OUT = 3, 1
PER_CLASS = 8_000
TREES, DEPTH, BINS, SHRINK = 24, 3, 32, 0.3
LASSO = 0.002


def _count(pattern: str) -> Column:
    """Characters of the text that ``pattern`` covers."""
    return F.col("n_chars") - F.length(F.regexp_replace("_text", pattern, ""))


def statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the ``carried`` columns and the text's statistics, all computed on the whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, text.alias("_text"),
                      F.length(text).alias("n_chars"))
    words = F.filter(F.split("_text", f"[{SPACES}]+"), lambda w: w != "")
    counted = one.select("doc_id", *carried, "n_chars", words.alias("_words"), F.split("_text", "\n").alias("_lines"),
                         _count(r"\p{Lu}+").alias("_upper"), _count(r"\p{L}+").alias("_letters"),
                         _count(r"\p{Nd}+").alias("_digits"), _count(r"[!?]+").alias("_bangs"),
                         _count(r"[|]+").alias("_bars"), _count(r"[#$%&*@^~+=<>{}\\/\[\]_]+").alias("_symbols"),
                         _count(r"[.,;:]+").alias("_stops"))
    sized = counted.select("*", F.size("_words").alias("n_words"), F.size(F.array_distinct("_words")).alias("_kinds"),
                           F.size("_lines").alias("n_lines"), F.size(F.array_distinct("_lines")).alias("_line_kinds"))

    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return sized.select(
        "doc_id", *carried, F.log1p(F.col("n_words").cast("double")).alias("log_words"),
        per("_letters", "n_words").alias("word_length"), per("_upper", "_letters").alias("upper"),
        per("_letters", "n_chars").alias("letters"), per("_digits", "n_chars").alias("digits"),
        per("_bangs", "n_words").alias("bangs"), per("_bars", "n_words").alias("bars"),
        per("_symbols", "n_words").alias("symbols"), per("_stops", "n_words").alias("stops"),
        per("_kinds", "n_words").alias("word_kinds"), per("_line_kinds", "n_lines").alias("line_kinds"),
        per("n_words", "n_lines").alias("line_words"))


STATISTICS = ("log_words", "word_length", "upper", "letters", "digits", "bangs", "bars", "symbols", "stops",
              "word_kinds", "line_kinds", "line_words")


class Node:
    __slots__ = ("feature", "cut", "left", "right", "value")

    def __init__(self, value=0.0, feature=-1, cut=0.0, left=None, right=None):
        self.value, self.feature, self.cut, self.left, self.right = value, feature, cut, left, right


def grow(binned, cuts, grad, hess, rows, depth) -> Node:
    """A regression tree on gradients, by histograms; split where the gain is largest."""
    g, h = grad[rows].sum(), hess[rows].sum()
    node = Node(value=-SHRINK * g / (h + 1.0))
    if depth == 0 or len(rows) < 20:
        return node
    best = (1e-3, -1, -1)
    for f in range(binned.shape[1]):
        b = binned[rows, f]
        gs, hs = (np.cumsum(np.bincount(b, weights=x[rows], minlength=BINS))[:-1] for x in (grad, hess))
        gain = gs ** 2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g ** 2 / (h + 1)
        gain[:max(0, b.min())] = 0
        k = int(gain.argmax())
        if k < len(cuts[f]) and gain[k] > best[0]:
            best = (gain[k], f, k)
    if best[1] < 0:
        return node
    _, f, k = best
    side = binned[rows, f] <= k
    if side.all() or not side.any():
        return node
    node.feature, node.cut = f, float(cuts[f][k])
    node.left = grow(binned, cuts, grad, hess, rows[side], depth - 1)
    node.right = grow(binned, cuts, grad, hess, rows[~side], depth - 1)
    return node


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, predict(node.left, x), predict(node.right, x))


def paths(node: Node, so_far: tuple = ()) -> list[tuple]:
    """Every path below the root as a conjunction of (feature, at most?, cut)."""
    out = [so_far] if so_far else []
    if node.feature >= 0:
        out += paths(node.left, (*so_far, (node.feature, True, node.cut)))
        out += paths(node.right, (*so_far, (node.feature, False, node.cut)))
    return out


def boost(x: np.ndarray, y: np.ndarray) -> list[Node]:
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin, trees = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(binned, cuts, p - y, p * (1 - p), np.arange(len(y)), DEPTH)
        margin += predict(tree, x)
        trees.append(tree)
    return trees


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, at_most, cut in rule:
        out &= (x[:, f] <= cut) == at_most
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient; the bias isn't penalised."""
    n, k = z.shape
    step = 4.0 / max(1e-9, float(np.linalg.eigvalsh(np.column_stack([z, np.ones(n)]).T @ np.column_stack(
        [z, np.ones(n)]) / n)[-1]))
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(z @ vw + vb, -30, 30))) - y
        nw = vw - step * (z.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = LASSO) -> tuple[list[tuple[tuple, float]], float]:
    """[(rule, weight)] and the bias."""
    rules = sorted({p for t in boost(x, y) for p in paths(t)}) if len(y) and y.min() < y.max() else []
    if not rules:  # one class, or statistics that no cut tells apart: the share of the class
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        return [], float(np.log(share / (1 - share)))
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    _, first = np.unique(z, axis=1, return_index=True)  # rules that hold on the same rows count once
    first.sort()
    w, b = lasso_logistic(z[:, first], y, penalty)
    return [(rules[i], float(v)) for i, v in zip(first.tolist(), w) if abs(v) > 1e-6], b


def compile_rules(rules: list[tuple[tuple, float]], bias: float) -> Column:
    """The ensemble's probability as one column over the statistics."""
    total = F.lit(bias)
    for rule, weight in rules:
        both = None
        for f, at_most, cut in rule:
            one = F.col(STATISTICS[f]) <= cut if at_most else F.col(STATISTICS[f]) > cut
            both = one if both is None else both & one
        total = total + F.when(both, F.lit(weight)).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a row of ``docs``: doc_id, the statistics, held_out, score."""
    sample = training_sample(docs, labels, "quality", FOLDS, HELD_OUT, PER_CLASS)
    seen = statistics(sample, "y").select("y", *STATISTICS).collect()  # at most 2 x PER_CLASS rows
    data = np.array(sorted(tuple(r) for r in seen), float).reshape(len(seen), 1 + len(STATISTICS))
    rules, bias = fit_rules(data[:, 1:], data[:, 0])
    return (statistics(docs).withColumn("score", compile_rules(rules, bias))
            .withColumn("held_out", held_out("doc_id", FOLDS, HELD_OUT)))


def op4_rule_quality(spark, sf_dir):
    """Op 4 over the whole ``documents`` and ``labels`` tables."""
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
                  spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
