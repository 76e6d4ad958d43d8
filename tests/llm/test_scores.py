import math
import zlib
from collections import Counter

import numpy as np

from searchlane.llm import op4_rule_quality as o4
from searchlane.llm import op6_prefix_forest as o6
from searchlane.llm import op9_weak_toxicity as o9
from searchlane.llm import op10_logbilinear as o10
from tests.conftest import SF_MID, SF_SMALL

BIG = "/root/testdata/sf0.1"


def held_out_accuracy(spark, out, column):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    both = out.where("held_out").join(labels, "doc_id").toPandas()
    return (both.predicted == both[column]).mean(), both


def test_quality_on_held_out_labels(spark):
    accuracy, both = held_out_accuracy(spark, o4.op4_rule_quality(spark, BIG), "quality")
    assert accuracy > 0.98 and both.score.between(0, 1).all()


def test_toxicity_on_held_out_labels(spark):
    accuracy, both = held_out_accuracy(spark, o9.op9_weak_toxicity(spark, BIG), "toxic")
    assert accuracy > 0.97 and both.score.between(0, 1).all()
    assert ((both.predicted == 1) & (both.toxic == 0)).sum() <= 0.01 * len(both)


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(o4.STATISTICS)))
    y = ((x[:, 2] > 0.6) & (x[:, 5] <= 0.5)).astype(float)
    rules, bias = o4.fit_rules(x, y)
    margin = bias + sum(w * o4.holds(r, x) for r, w in rules)
    assert ((margin > 0) == (y == 1)).mean() > 0.97 and len(rules) < 120


def test_label_model_estimates_rates_and_discounts_copies():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    votes = np.zeros((len(y), o9.VOTERS))
    for j in range(o9.LEXICONS):
        votes[:, j] = rng.random(len(y)) < np.where(y, 0.5, 0.01)
    votes[:, 1] = votes[:, 0]  # a voter that repeats another
    got = o9.label_model(votes, np.ones(len(y)), np.full(len(y), -1))
    assert abs(got["share"] - 0.2) < 0.03
    assert abs(got["rates"][1, 3] - 0.5) < 0.05 and got["rates"][0, 3] < 0.03
    assert got["correlations"][0, 1] > 0.9 > 0.2 > abs(got["correlations"][2, 3])


def test_classifiers_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (2, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], labels.schema)
    for known in (labels, none):
        for out in (o4.quality(odd_docs, known), o9.toxicity(odd_docs, known)):
            rows = out.collect()
            assert len(rows) == odd_docs.count()
            assert all(0 <= r.score <= 1 for r in rows)
            assert all(r.held_out is False for r in rows if r.doc_id is None)
        assert o4.quality(no_docs, known).count() == 0 and o9.toxicity(no_docs, known).count() == 0


def test_forest_recall_and_exact_scores(spark):
    rows = spark.read.parquet(f"{SF_MID}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    got = o6.op6_prefix_forest(spark, SF_MID).toPandas()
    norm, found, wanted = np.linalg.norm(x, axis=1), 0, 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = x @ x[i] / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        own = got[got.query_id == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and (own.score.diff().dropna() <= 0).all()
        at = {v: s for v, s in zip(ids, score)}
        assert all(abs(at[v] - s) < 1e-12 for v, s in zip(own.vec_id, own.score))
        found, wanted = found + len(set(own.vec_id) & set(ids[order])), wanted + 5
    assert found / wanted >= 0.9


def test_forest_ascends_to_longer_lists():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((3000, 16)), rng.standard_normal((20, 16))
    forest = o6.Forest(x)
    sizes = []
    for wanted in (1, 500, 5000, 10 ** 9):
        lo, hi = forest.ranges(q, wanted)
        sizes.append([len(forest.candidates(lo[:, j], hi[:, j])) for j in range(len(q))])
    assert all(a <= b <= c <= d == 3000 for a, b, c, d in zip(*sizes))


def test_forest_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (50, v), (50, [3.0, 2.0, 1.0]), (1, v), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]),
            (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (None, v), (9, [1.0, 2.0]),
            (100, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = o6.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    first = [(r["rank"], r.vec_id) for r in got if r.query_id == 0]
    assert first == [(1, 1), (2, 2), (3, 50), (4, 50)]
    assert {r.query_id for r in got} == {0, 50} and 9 not in {r.vec_id for r in got}
    assert o6.nearest(df.limit(0), df.limit(0)).count() == 0


def test_language_model_counts_and_base(spark, small_texts):
    got = {r.doc_id: r for r in o10.op10_logbilinear(spark, SF_SMALL).collect()}
    words = {d: (t or "").encode().lower().split() + [b" "] for d, t in small_texts.items()}
    counts = Counter()
    for d, w in words.items():
        if zlib.crc32(str(d).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for d, w in words.items():
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), n)
        assert r.held_out == (zlib.crc32(str(d).encode()) % 10 == 0) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert r.score < 0


def test_language_model_beats_its_base_on_held_out_texts(spark):
    out = o10.op10_logbilinear(spark, SF_MID).where("held_out").toPandas()
    assert out.score.sum() > out.base_score.sum()


def test_language_model_probabilities_sum_to_one():
    noise = np.full(o10.CLASSES, 1 / o10.CLASSES)
    model = o10.Model.fresh(noise)
    contexts = np.array([[o10.CLASSES, o10.CLASSES], [0, 5], [511, 3]])
    assert np.allclose(np.exp(model.log_probabilities(contexts).astype(float)).sum(axis=1), 1, atol=1e-5)


def test_training_learns_a_pattern():
    rng = np.random.default_rng(0)
    target = np.tile([1, 2, 3], 4000)
    contexts = np.stack([np.roll(target, 2), np.roll(target, 1)], axis=1)
    noise = np.bincount(target, minlength=o10.CLASSES) + 1.0
    model = o10.Model.fresh(noise / noise.sum())
    squares = [np.zeros_like(p) for p in model.parts]
    for _ in range(60):
        model.train(contexts, target, squares, 0.1, rng)
    assert np.exp(model.log_probabilities(np.array([[1, 2]])))[0, 3] > 0.9


def test_language_model_odd_rows(odd_docs, no_docs):
    rows = o10.log_bilinear_scores(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 7)} == {1}
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert all(r.held_out is False for r in rows if r.doc_id is None)
    assert o10.log_bilinear_scores(no_docs).count() == 0
