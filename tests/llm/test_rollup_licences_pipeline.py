import duckdb
import pytest

import corpus_pipeline
from searchlane.llm import op1_token_rollup as o1
from searchlane.llm import op2_license_digest as o2
from searchlane.llm.queries import ORACLES, QUERIES
from searchlane.session import scratch_path
from tests.conftest import SF_SMALL
from tests.llm.test_decontam_mix import brute
from tests.llm.test_near_copies import brute_fingerprint, brute_groups, brute_windows
from tools.compare import TABLES, _rows

CHANGE = "doc_id long, op string, text string, source string, lang string"


@pytest.mark.parametrize("name", ["op1_token_rollup", "op2_license_digest"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SF_SMALL)
    rel = con.execute(ORACLES[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in rel.description], rel.fetchall())


def totals(rollup):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect() if r.tokenizer == "space-words-1"}


def test_rollup_deltas_and_idempotence(spark):
    rollup = o1.TokenRollup(spark, scratch_path(spark, "t_rollup"))

    def change(*rows):
        return spark.createDataFrame(list(rows), CHANGE)

    assert totals(rollup) == {}
    first = change((1, "insert", "a b c", "s", "en"), (2, "insert", "a", "s", "en"), (2, "insert", "a", "s", "en"),
                   (3, "insert", None, None, None), (None, "insert", "x y", "t", None))
    assert rollup.commit("b1", first)
    now = {("s", "en"): (2, 4), (None, None): (1, 0), ("t", None): (1, 2)}
    assert totals(rollup) == now
    assert not rollup.commit("b1", first) and totals(rollup) == now
    assert rollup.commit("b2", change((1, "revise", "a b c d e", "s", "de"), (9, "delete", None, None, None),
                                      (None, "delete", None, "t", None)))
    now = {("s", "en"): (1, 1), ("s", "de"): (1, 5), (None, None): (1, 0)}
    assert totals(rollup) == now
    assert rollup.compact() and totals(rollup) == now
    assert rollup.commit("b3", change((2, "delete", None, None, None), (2, "insert", "z z", "s", "en")))
    assert rollup.commit("b4", change().limit(0))
    assert totals(rollup) == {("s", "de"): (1, 5), (None, None): (1, 0)}
    assert rollup.committed() == ["b1", "b2", "b3", "b4"]


def test_rollup_with_a_public_vocabulary(spark):
    import public_tokenizers as public
    counted = o1.TokenRollup(spark, scratch_path(spark, "t_bpe"), {
        "bpe-50k": o1.bpe_count(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)})
    counted.commit("b", spark.createDataFrame([(1, "insert", "hello world", "s", "en"), (2, "insert", None, "s", "en")], CHANGE))
    assert [tuple(r) for r in counted.totals().collect()] == [("s", "en", "bpe-50k", 2, 2)]


def test_licences_match_in_other_dress(spark, odd_docs, no_docs):
    mit = next(t for n, t in o2.LICENCES if n == "MIT")
    texts = ["Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ;"), mit.replace("sublicense", "sub-licence"),
             "x\nALL rights   reserved\n released under the MIT Licence!", mit + " and more", "(c) 2020 nobody"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.license_id, r.notices) for r in o2.scan(docs, o2.known_licences(spark)).collect()}
    assert got == {0: ("MIT", "MIT"), 1: ("MIT", "MIT"), 2: (None, "MIT,NONE-reserved"), 3: (None, ""), 4: (None, "")}
    odd = o2.scan(odd_docs, o2.known_licences(spark)).collect()
    assert len(odd) == odd_docs.count() and not any(r.license_id for r in odd)
    assert o2.scan(no_docs, o2.known_licences(spark)).count() == 0


def test_pipeline_stages_match_brute_force(spark, small_docs):
    from searchlane.llm import scratch
    docs = small_docs
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.store(stage(spark, docs, SF_SMALL), "t_stage")
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r for r in out.collect()}
        if name != "mix_sources":
            assert out.columns == small_docs.columns
        if name == "toxicity":
            assert 0 < len(after) <= len(before) and all(after[d].text == before[d] for d in after)
        elif name == "simhash_near_dedup":
            assert set(after) == set(brute_groups({d: brute_fingerprint(t) for d, t in before.items()}).values())
        elif name == "substring_dedup":
            for d, (n, kept) in brute_windows(before).items():
                whole = len(kept) == n
                assert after[d].text == (before[d] if whole else b" ".join(kept).decode())
        elif name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text")
            hit = {d for d, _, h, _ in brute(before.items(), [tuple(r) for r in bench.collect()]) if h}
            assert set(after) == set(before) - hit
        else:
            assert set(after) == set(before) and all(r.taken <= 2 * r["size"] for r in after.values())
        docs = out


def test_pipeline_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            if name != "mix_sources":
                assert out.columns == docs.columns
            assert out.count() <= docs.count()
