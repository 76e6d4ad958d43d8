import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchlane.llm import op13_odd_sketches as o13
from tests.conftest import SF_MID, SF_SMALL


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set())


def brute(docs):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    sets, parent, holders = {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        common = {}
        for x in s:
            for e in holders.setdefault(x, []):
                common[e] = common.get(e, 0) + 1
            holders[x].append(d)
        for e, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[e]) - n):
                lo, hi = sorted((find(d), find(e)))
                parent[hi] = lo
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in docs)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_matches_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sorted(map(tuple, o13.op13_odd_sketches(spark, sf).collect()))
    assert got == brute(docs) and len({r[2] for r in got}) < len(got)


def test_a_group_of_edited_copies(spark):
    """Copies with 0 to 25 % of their words changed: some link to the first only through others."""
    rng, base = random.Random(5), [f"w{i}" for i in range(120)]
    docs = {}
    for d in range(300):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 30)):
            words[at] = f"x{rng.randrange(10 ** 6)}"
        docs[d] = " ".join(words)
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute(docs)
    assert sorted(map(tuple, o13.near_groups(frame).collect())) == want
    assert len({r[2] for r in want}) > 5


def test_a_chain_of_documents_is_one_component(spark):
    docs = {i: " ".join(f"w{j}" for j in range(i * 4, i * 4 + 60)) for i in range(12)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert sorted(map(tuple, o13.near_groups(frame).collect())) == brute(docs)


def test_few_representatives_per_salt(spark, monkeypatch):
    monkeypatch.setattr(o13, "PER_SALT", 2)
    docs = {i: " ".join(f"w{j}" for j in range(80)) + f" end{i}" for i in range(25)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.component_id for r in o13.near_groups(frame).collect()} == {0}


def test_sketches_estimate_similarity():
    rng, sampler = np.random.default_rng(1), o13.Sampler()
    for true, spread in ((0.95, 0.015), (0.8, 0.03), (0.6, 0.045)):
        got = []
        for _ in range(60):
            h = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            n = round(400 * true / (1 + true))  # shared by two sets of 200
            shared, a, b = h[:n], h[n:n + 200 - n], h[300:300 + 200 - n]
            s, t = (sampler.sketch(sampler.samples(np.concatenate((shared, x)))) for x in (a, b))
            m = int(np.bitwise_count(s ^ t).sum())
            got.append(1 + 1024 / (4 * 324) * np.log(1 - 2 * m / 1024))
            exact = n / (400 - n)
        assert abs(np.mean(got) - exact) < 0.015 and np.std(got) < spread
    assert 0.6 < o13.sketch_floor() < 0.7


def test_bands_meet_at_the_threshold():
    rng, sampler, met = np.random.default_rng(2), o13.Sampler(), 0
    for _ in range(300):
        h = rng.integers(0, 1 << 63, 110, dtype=np.uint64)
        a, b = sampler.samples(h[:100]), sampler.samples(np.concatenate((h[:88], h[100:])))  # 88 of 110: 0.8
        met += bool((sampler.keys(a) == sampler.keys(b)).any())
    assert met >= 299


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted(map(tuple, o13.near_groups(odd_docs).collect()), key=str)
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[7] == [(0, 7, True)]
    assert by[1] == [(20, 1, True)] and by[2] == [(20, 1, False)] * 2
    assert sorted(by[None], key=str) == [(0, None, False), (20, 1, False)]
    assert by[5] == [(by[5][0][0], 5, True)] and by[6] == [(by[5][0][0], 5, False)]
    ids = odd_docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r.component_id for r in o13.near_groups(ids).collect()} == {None}
    assert o13.near_groups(no_docs).count() == 0
