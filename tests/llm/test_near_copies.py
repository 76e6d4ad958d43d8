import hashlib

import numpy as np
import xxhash

from searchlane.llm import op3_substring_dedup as o3
from searchlane.llm import op5_simhash_golay as o5
from searchlane.llm.graph import components
from tests.conftest import SF_SMALL


def brute_windows(texts, window=13):
    """Words kept per document, by a dictionary of all windows."""
    first, out = {}, {}
    for d in sorted(texts):
        w = (texts[d] or "").encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), d)
    for d in texts:
        w = (texts[d] or "").encode().split()
        stay = [True] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < d:
                stay[i:i + window] = [False] * window
        out[d] = (len(w), [x for x, s in zip(w, stay) if s])
    return out


def test_substring_dedup_matches_brute_force(spark, small_texts):
    got = {r.doc_id: r for r in o3.op3_substring_dedup(spark, SF_SMALL).collect()}
    want = brute_windows(small_texts)
    assert got.keys() == want.keys()
    for d, (n, kept) in want.items():
        assert (got[d].n_words, got[d].n_removed) == (n, n - len(kept))
        assert got[d].kept_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()


def test_substring_dedup_branches_and_self_repeats(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(15)) for x in "abc")
    texts = {1: f"{a} {b}", 2: f"{a} {c}", 3: f"{b} {c} {a}", 4: f"{c} {c}", 5: f"z {a} {b} z", 9: f"{a} {b}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in o3.substring_dedup(docs).collect()}
    for d, (n, kept) in brute_windows(texts).items():
        assert (got[d].n_words, got[d].kept_text) == (n, b" ".join(kept).decode()), d


def test_substring_dedup_odd_rows(odd_docs, no_docs):
    rows = o3.substring_dedup(odd_docs, layout=True).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_removed == 0 and by[1][0].rest.rid == "x"
    assert [r.n_removed for r in by[2]] == [20, 20] and by[2][0].kept_text == "two"
    assert by[3][0].n_words == 0 and by[4][0].kept_text == ""
    assert {(r.n_words, r.n_removed) for r in by[None]} == {(21, 20), (0, 0)}
    assert by[5][0].n_removed == 0 and by[6][0].n_removed == by[6][0].n_words == 60_000
    assert by[7][0].n_words == 0 and by[7][0].kept_text == " \t\n\x0b\x0c\r " and by[8][0].n_words == 4
    assert o3.substring_dedup(no_docs).count() == 0


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps):
    ids, parent = sorted(fps), {d: d for d in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(ids):
        for y in ids[i + 1:]:
            if (fps[x] ^ fps[y]).bit_count() <= 3 and find(x) != find(y):
                lo, hi = sorted((find(x), find(y)))
                parent[hi] = lo
    return {d: find(d) for d in ids}


def test_simhash_groups_match_brute_force(spark, small_texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in o5.op5_simhash_golay(spark, SF_SMALL).collect()}
    fps = {d: brute_fingerprint(t) for d, t in small_texts.items()}
    roots = brute_groups(fps)
    assert got == {d: ("%016x" % fps[d], roots[d]) for d in fps}


def test_golay_keys_miss_no_pair_within_three_bits():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    y = x.copy()
    for k in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 4000, dtype=np.uint64)
    tables, hit = o5.key_tables(), np.zeros(4000, bool)
    part = [[(v >> np.uint64(at)).astype(np.int64) & ((1 << n) - 1) for at, n in o5.SEGMENTS] for v in (x, y)]
    for i, j, k in o5.segment_triples():
        own, near = tables[k]
        same = (part[0][i] == part[1][i]) & (part[0][j] == part[1][j])
        hit |= same & (near[part[1][k]] == own[part[0][k]][:, None]).any(axis=1)
    assert hit.all()


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, step=997)
    fixed = o5._corrections()[o5._remainder(words)]
    assert (o5._remainder(words ^ fixed) == 0).all() and np.bitwise_count(fixed).max() <= 3


def test_linked_fingerprints_chain_into_one_component(spark):
    base = 0x0123456789ABCDEF
    fps = [base, base ^ 0b111, base ^ 0b111111, base ^ (0b1111 << 40)]
    links = o5.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert sorted(map(tuple, links.collect())) == sorted(tuple(sorted(p)) for p in [(fps[0], fps[1]), (fps[1], fps[2])])
    got = dict(map(tuple, components(links).collect()))
    assert got == {f: min(fps[:3]) for f in fps[:3]}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (1, 0)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd_rows(odd_docs, no_docs):
    got = o5.simhash_groups(odd_docs).collect()
    assert len(got) == odd_docs.count()
    empty = {r.component_id for r in got if r.fp == 0}
    assert empty == {3}  # null and empty texts share fingerprint zero; the smallest id names them
    kept = o5.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert len({r.root for r in got}) == len({(r.doc_id, r.text) for r in kept.collect()})
    assert o5.simhash_groups(no_docs).count() == 0 and o5.keep_one(no_docs).count() == 0
