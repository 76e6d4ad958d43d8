import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from searchlane.llm import op11_importance_resampling as o11
from tests.conftest import SF_SMALL


def runs(text, longest=3):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i:i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1)]


def bucket(run):
    return zlib.crc32(run.encode()) % 10_000


def brute(docs, target, share=5):
    """(doc_id, n_features, weight, score, rank) of every document, by dictionaries and one sort."""
    s, t = {}, {}
    for texts, held in ((docs, s), (target, t)):
        for _, text in texts:
            for r in runs(text)[1]:
                held[bucket(r)] = held.get(bucket(r), 0) + 1
    up, down = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log((t.get(b, 0) + 1) * up / ((s.get(b, 0) + 1) * down))) for b in range(10_000)]
    rows, able = [], []
    for d, text in docs:
        n, f = runs(text)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(r)] for r in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(f), weight, score, None])
        if n >= 20:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[:share * len(able) // 100]):
        r[4] = i + 1
    return sorted(map(tuple, rows), key=str)


def test_query_matches_brute_force(spark, small_docs):
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    got = sorted(map(tuple, o11.op11_importance_resampling(spark, SF_SMALL).collect()), key=str)
    assert got == brute([tuple(r) for r in small_docs.select("doc_id", "text").collect()],
                        [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert sum(r[4] is not None for r in got) > 3


def test_checksums_of_runs_need_no_joined_text():
    words = [b"a", b"bc", "naïve".encode(), b"x" * 63, b"y" * 64, b"z" * 5000, b"q", b"w" * 129]
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    sums = o11.run_checksums(crc, np.array([len(w) for w in words]), 4, o11.Shifts())
    for m, got in enumerate(sums, 1):
        assert got.tolist() == [zlib.crc32(b" ".join(words[i:i + m])) for i in range(len(words) - m + 1)]


@pytest.mark.parametrize("piece", [1, 7, 40, 1 << 20])
def test_features_do_not_depend_on_the_pieces(piece):
    texts = ["One two-three, four  5 six", None, "", "...", "solo", "a b", "É è " * 9, "long" * 30 + " end of it"]
    got, want = {}, {}
    for row, at, _ in o11.features([t.encode() if t is not None else None for t in texts], 10_000, 3, o11.Shifts(), piece):
        for r, b in zip(row.tolist(), at.tolist()):
            got.setdefault(r, []).append(b)
    for i, t in enumerate(texts):
        if (f := runs(t)[1]):
            want[i] = sorted(map(bucket, f))
    assert {r: sorted(b) for r, b in got.items()} == want


def test_quickselect_finds_every_rank(spark):
    rows = [(i * 7919 % 23, None if i % 9 == 0 else i % 13, i % 2, i) for i in range(300)]
    df = spark.createDataFrame(rows, "score long, doc_id long, n_features long, place long")
    order = sorted((-s, d is None, d or 0, n, p) for s, d, n, p in rows)
    for k in (1, 2, 77, 150, 299, 300):
        assert o11.kth_key(df, k, pivots=3) == order[k - 1]
    with pytest.raises(ValueError):
        o11.kth_key(df, 301)


def test_odd_rows_ties_and_draws(spark, odd_docs, no_docs):
    target = spark.createDataFrame([(1, "p1 p2 p3 p4"), (2, None)], "item_id long, text string")
    pairs, want = ([tuple(r) for r in x.select(*c).collect()] for x, c in
                   ((odd_docs, ("doc_id", "text")), (target, ("item_id", "text"))))
    out = o11.resample(odd_docs, target, share_percent=50)
    cols = ("doc_id", "n_features", "weight", "score", "rank")
    assert sorted([tuple(r[c] for c in cols) for r in out.collect()], key=str) == brute(pairs, want, 50)
    drawn = o11.draw(odd_docs, target, share_percent=50).orderBy("rank").collect()
    assert [r.rank for r in drawn] == list(range(1, len(drawn) + 1)) and drawn[0].rest.lang == "en"
    assert o11.resample(no_docs, target).count() == 0
    empty = o11.resample(odd_docs, target.limit(0), share_percent=100).collect()
    assert sorted(r.rank for r in empty if r["rank"] is not None) == list(range(1, 7))


def test_one_text_repeated_many_times(spark):
    docs = spark.range(400).selectExpr("id % 3 as doc_id")
    docs = docs.selectExpr("doc_id", f"'{' '.join(f'w{i}' for i in range(25))}' as text")
    target = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    out = o11.resample(docs, target).where("rank is not null").collect()
    assert sorted(r["rank"] for r in out) == list(range(1, 21)) and len({r.doc_id for r in out}) == 1
