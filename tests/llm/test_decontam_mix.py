import hashlib
import re

import duckdb

from searchlane.llm import op7_suffix_decontam as o7
from searchlane.llm import op8_mix_sources as o8
from tests.conftest import SF_SMALL


def fold(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    windows = {}
    for name, text in items:
        w = fold(text)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a:a + k]), set()).add("null" if name is None else str(name))
    widths = {len(k) for k in windows}
    out = []
    for d, text in docs:
        w = fold(text)
        hit, found = set(), set()
        for k in widths:
            for a in range(len(w) - k + 1):
                if (names := windows.get(tuple(w[a:a + k]))):
                    found |= names
                    hit.update(range(a, a + k))
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def test_decontamination_matches_brute_force(spark, small_docs):
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in o7.op7_suffix_decontam(spark, SF_SMALL).collect()}
    want = brute([tuple(r) for r in small_docs.select("doc_id", "text").collect()],
                 [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert got == {d: (n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0) for d, n, h, f in want}
    assert any(h for _, _, h, _ in want)


def test_decontamination_in_blocks_short_items_and_matches(spark):
    items = [(1, " ".join(f"q{i}" for i in range(14))), (2, "Just Three words"), (3, None), (4, "?!"),
             (None, " ".join(f"n{i}" for i in range(10))), (1, " ".join(f"q{i}" for i in range(14))),
             (5, " ".join(f"q{i}" for i in range(4, 30)))]
    docs = [(1, "see " + " ".join(f"q{i}" for i in range(14)) + " end"), (2, "just, three-WORDS just three"),
            (3, " ".join(f"n{i}" for i in range(9))), (4, " ".join(f"N{i}" for i in range(10))), (5, None)]
    d, b = (spark.createDataFrame(x, s) for x, s in ((docs, "doc_id long, text string"),
                                                     (items, "item_id long, text string")))
    for block_bytes in (o7.BLOCK_BYTES, 40):  # one block, and one of about an item
        got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]))
               for r in o7.contamination(d, b, block_bytes=block_bytes).orderBy("doc_id").collect()]
        assert got == brute(docs, items)
    row = o7.contamination(d, b).where("doc_id = 1").first()
    assert max((m.n, m.at) for m in row.matches) == (14, 1)  # the longest verbatim match and its place


def test_decontamination_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(3, 20)))], "item_id long, text string")
    kept = o7.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5", "6", "7", "8", "None"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert o7.decontaminate(odd_docs, none).count() == odd_docs.count()
    assert o7.contamination(no_docs, bench).count() == 0


def test_mix_matches_its_oracle(spark):
    got = sorted(tuple(r) for r in o8.op8_mix_sources(spark, SF_SMALL).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = sorted(con.execute(o8.ORACLE).fetchall())
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want))


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 17, 1000):
        df = spark.range(n).select(o8.permuted(o8.F.col("id"), o8.F.lit(n).cast("long"),
                                               o8.round_keys(o8.F.lit(3).cast("long"))).alias("y"))
        assert sorted(r.y for r in df.collect()) == list(range(n))


def test_targets_stop_at_twice_the_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in o8.targets(sizes).collect()}
    assert got["a"] == 20 and got["d"] == 0 and got[None] == 10
    assert abs(got["b"] / got["c"] - 2) < 1e-9 or got["b"] == 2000
    assert abs(sum(got.values()) - 1.5 * 2015) < 1e-6


def test_mix_is_near_targets_and_texts_fill_blocks(spark, small_docs):
    out = o8.mix(small_docs).toPandas()
    assert (out.taken <= 2 * out["size"]).all()
    by = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= 2 * o8.BLOCK).all()
    blocks = o8.mixed_blocks(small_docs).toPandas()
    assert int(blocks.text.str.split().str.len().sum()) == int(out.taken.sum())
    assert (blocks.text.str.split().str.len() <= o8.BLOCK).all()
    assert not blocks.duplicated(["out_shard", "out_place"]).any()


def test_mix_odd_rows(odd_docs, no_docs):
    rows = o8.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert {r["source"] for r in rows} == {"a", "b", None}
    assert o8.mix(no_docs).count() == 0 and o8.mixed_blocks(no_docs).count() == 0
