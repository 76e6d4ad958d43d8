"""Toxicity by weak supervision.

1. *Lexicons.* Document frequencies of words and of five- and seven-letter stems in a bounded sample
   of labelled training documents give terms that the positive class uses far above chance (G-test).
2. *Voters.* The terms are dealt over several word and stem lexicons; each lexicon and a
   few patterns (several distinct terms, density, shouting, masked words) vote on every
   document.
3. *Label model.* Counts of vote patterns over all training documents (a few
   thousand rows at most) feed a generative model fitted by EM, labelled
   training documents keeping their label: the class share, each voter's hit rate
   in either class, and the voters' correlations within the classes, by which voters
   that repeat each other are discounted.
4. *Classifier.* A ridge-penalised logistic regression over the voters' counts and styles,
   trained on the posterior labels of a bounded sample, scores every document.

Scoring is one pass without a shuffle of texts. Bounds (documented parameters):
``PER_CLASS`` labelled documents a class, ``TERMS`` lexicon terms, ``FIT_ROWS`` rows for
the classifier. Counts of vote patterns cover all training documents.

Defined cases: null and empty texts have no words and get the score of a text without
hits; rows without a usable id are scored and never held out; repeated rows give one row
each; without labels of both classes no lexicon exists and every score is 0; an empty
table gives an empty result; other columns travel in a struct.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from searchlane.llm import scratch
from searchlane.llm.labels import held_out, training_sample
from searchlane.llm.op3_substring_dedup import rest_of

FOLDS, HELD_OUT = 5, 0
PER_CLASS = 10_000
TERMS = 1_000
FIT_ROWS = 20_000
STEMS = (5, 7)
WORD_LEXICONS, STEM_LEXICONS = 6, 3
MIN_G, MIN_LIFT = 24.0, 8.0
WORD = re.compile(r"[^\W\d_]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
MASKED = re.compile(r"\b[^\W\d_][*@#$%]{2,}[^\W\d_]")
LEXICONS = WORD_LEXICONS + STEM_LEXICONS
VOTERS = LEXICONS + 5


def terms_of(text: str) -> tuple[list[str], set[str]]:
    """Words in lower case, and the distinct terms: words, and stems written ``stem*``."""
    words = WORD.findall(text.lower())
    distinct = set(words)
    return words, distinct.union(*({w[:n] + "*" for w in distinct if len(w) > n} for n in STEMS))


def _term_counts(batches):
    for batch in batches:
        held = (Counter(), Counter())
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            held[y].update(terms_of(text or "")[1])
        terms = list(held[0].keys() | held[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string())] + [
            pa.array([h[t] for t in terms], pa.int64()) for h in held], ["term", "n0", "n1"])


def learn_lexicon(sample: DataFrame, terms: int = TERMS) -> list[str]:
    """Terms that mark the positive class, strongest first."""
    sample = sample.dropDuplicates(["y", "text"])  # copies aren't independent evidence
    size = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if not size.get(0) or not size.get(1):
        return []
    n1, n0, share = F.col("n1"), F.col("n0"), size[1] / (size[0] + size[1])
    lift = F.log((n1 + 0.5) / (size[1] + 1)) - F.log((n0 + 0.5) / (size[0] + 1))
    g = 2 * (n1 * F.log(n1 / ((n1 + n0) * share))
             + F.when(n0 > 0, n0 * F.log(n0 / ((n1 + n0) * (1 - share)))).otherwise(0.0))
    ranked = (sample.mapInArrow(_term_counts, "term string, n0 long, n1 long")
              .groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
              .where((n1 > 0) & (lift >= float(np.log(MIN_LIFT)))).withColumn("g", g).where(F.col("g") >= MIN_G)
              .orderBy(F.desc("g"), "term").limit(terms))
    return [r.term for r in ranked.collect()]


def lexicons(terms: list[str]) -> dict[str, int]:
    """Number of the lexicon of each term: words and stems are dealt out in turn."""
    out, words, stems = {}, 0, 0
    for t in terms:
        if t.endswith("*"):
            out[t], stems = WORD_LEXICONS + stems % STEM_LEXICONS, stems + 1
        else:
            out[t], words = words % WORD_LEXICONS, words + 1
    return out


def observe(text: str | None, lexicon: dict[str, int]) -> tuple[list[float], int]:
    """Inputs of the classifier, and the votes as bits."""
    text = text or ""
    words = WORD.findall(text.lower())
    hits, matched = [0] * LEXICONS, set()
    for w in set(words):
        for t in (w, *(w[:n] + "*" for n in STEMS if len(w) > n)):
            if t in lexicon:
                hits[lexicon[t]] += 1
                matched.add(w)
    kinds = len(matched)
    total = sum(1 for w in words if w in matched) if matched else 0
    density = 1000.0 * total / max(1, len(words))
    upper = sum(map(len, UPPER.findall(text))) / max(1, sum(map(len, words)))
    masked = len(MASKED.findall(text))
    votes = [h > 0 for h in hits] + [kinds >= 2, kinds >= 4, total >= 2 and density >= 2.0, upper > 0.5, masked > 0]
    x = [min(h, 3) / 3 for h in hits] + [float(np.log1p(kinds)), float(np.log1p(total)), float(np.log1p(density)),
                                          float(kinds >= 2), float(kinds >= 3), upper, float(np.log1p(masked))]
    return x, sum(1 << j for j, v in enumerate(votes) if v)


def label_model(votes: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 60) -> dict:
    """EM over vote patterns (rows of ``votes``) with their ``counts``; ``known`` holds the
    label of the rows that have one, else -1, and fixes their share in the estimates.

    Returns the share of the positive class, hit rates (2 x voters), within-class
    correlations, and the posterior of each pattern. A voter's evidence is divided by one
    plus its positive correlations with the others, so that copies count about once."""
    n = counts / max(1.0, counts.sum())
    lex = votes[:, :LEXICONS]
    post = np.where(lex.sum(axis=1) >= 2, 0.95, np.where(lex.any(axis=1), 0.6, 0.02))
    corr = np.eye(votes.shape[1])
    for _ in range(rounds):
        held = np.where(known >= 0, known, post)
        w = np.stack([n * (1 - held), n * held])
        mass = w.sum(axis=1, keepdims=True)
        rate = (w @ votes + 1e-4 * (votes * n[:, None]).sum(axis=0) + 1e-6) / (mass + 1e-4 + 2e-6)
        cov = sum((w[y][:, None] * (votes - rate[y])).T @ (votes - rate[y]) for y in (0, 1))
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = cov / np.outer(sd, sd)
        trust = 1.0 / (1.0 + np.maximum(corr - np.eye(len(corr)), 0).sum(axis=1))
        evidence = (votes * trust) @ np.log(rate[1] / rate[0]) + ((1 - votes) * trust) @ np.log(
            (1 - rate[1]) / (1 - rate[0]))
        prior = np.clip(mass[1, 0], 1e-4, 0.5)
        post = 1 / (1 + np.exp(-np.clip(evidence + np.log(prior / (1 - prior)), -30, 30)))
    return {"share": float(mass[1, 0]), "rates": rate, "correlations": corr, "posterior": post}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton steps for a weighted logistic regression on soft labels; the bias comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    theta, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-8
    weight = weight / weight.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * theta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        theta -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-8:
            break
    return theta


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a row of ``docs``: doc_id, text, held_out, score, votes, and other columns in ``rest``."""
    lexicon = lexicons(learn_lexicon(training_sample(docs, labels, "toxic", FOLDS, HELD_OUT, PER_CLASS)))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *rest_of(docs))

    def seen(batches):
        for batch in batches:
            rows = [observe(t, lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.list_(pa.float64())),
                 pa.array([r[1] for r in rows], pa.int32())], ["doc_id", "x", "votes"])

    if not lexicon:
        theta = None
    else:
        marks = scratch.store(
            base.where(~held_out("doc_id", FOLDS, HELD_OUT)).select("doc_id", "text")
            .mapInArrow(seen, "doc_id long, x array<double>, votes int"), "toxicity_votes")
        truth = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
                 .where(F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y")))
        counted = (marks.join(truth, "doc_id", "left").groupBy("votes", F.coalesce("y", F.lit(-1)).alias("y"))
                   .count().orderBy("votes", "y").collect())  # at most 3 x 2^VOTERS rows
        patterns = np.array([r.votes for r in counted], np.int64)
        grid = ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(float)
        model = label_model(grid, np.array([r["count"] for r in counted], float),
                            np.array([r.y for r in counted]))
        posterior = dict(zip(patterns.tolist(), model["posterior"].tolist()))
        hit = F.col("votes").bitwiseAND((1 << LEXICONS) - 1) > 0
        order = F.xxhash64("doc_id", F.lit(11))
        drawn = [marks.where(c).orderBy(order, "doc_id").limit(FIT_ROWS // 2).select("x", "votes").collect()
                 for c in (hit, ~hit)]
        rows = [r for part in drawn for r in part]
        share = [sum(r["count"] for r in counted if bool(r.votes & ((1 << LEXICONS) - 1)) == side) / max(1, len(part))
                 for side, part in zip((True, False), drawn)]
        theta = fit_logistic(np.array([r.x for r in rows]), np.array([posterior[r.votes] for r in rows]),
                             np.repeat(share, [len(p) for p in drawn]).astype(float))
        scratch.discard(marks)

    def scored(batches):
        for batch in batches:
            rows = [observe(t, lexicon) for t in batch.column("text").to_pylist()]
            if theta is None:
                score = np.zeros(len(rows))
            else:
                x = np.array([r[0] for r in rows]).reshape(len(rows), -1)
                score = 1 / (1 + np.exp(-np.clip(x @ theta[:-1] + theta[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array([r[1] for r in rows], pa.int32())],
                [*batch.schema.names, "score", "votes"])

    schema = StructType([*base.schema.fields, StructField("score", DoubleType()), StructField("votes", IntegerType())])
    return base.mapInArrow(scored, schema).withColumn("held_out", held_out("doc_id", FOLDS, HELD_OUT))


def op9_weak_toxicity(spark, sf_dir):
    """Op 9 over the whole ``documents`` and ``labels`` tables."""
    out = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
                   spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "votes")
