"""Exact and cell search: lengths, bounds, pruning and recall."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from searchlane.operators import dense
from searchlane.operators.dense import (build_cell_index, cell_candidates, cell_search, dense_search,
                                        probes_for_recall, read_cell_index, recall_at_k)
from searchlane.sources import fixtures as fx
from searchlane.sources.tables import Tables
from tests.conftest import SF_MID, SF_SMALL


def hits(df):
    return sorted((r.query_id, r["rank"], r.doc_id) for r in df.collect())


def test_lengths_do_not_mix_and_nulls_take_no_part(spark):
    vecs = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [0.0, 1.0, 5.0, 5.0]), (3, [0.0, 1.0]), (4, None), (5, [None, 9.0]), (6, []),
         (7, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0]), (3, None)],
                              "query_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in dense_search(q, vecs, k=3).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 3, 0.0), (1, 1, 2, 0.0)]


def test_many_shards_and_blocks_equal_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.integers(-3, 4, (300, 5)).astype(float)
    vecs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:40])], "query_id long, embedding array<double>")
    monkeypatch.setattr(dense, "SHARD_ROWS", 17)
    want = []
    for i in range(40):
        s = v @ v[i]
        want += [(i, r, int(d)) for r, d in enumerate(np.lexsort((np.arange(300), -s))[:4], 1)]
    assert hits(dense_search(q, vecs, k=4)) == sorted(want)
    index = build_cell_index(vecs, 5)
    assert index.table.select("cell", "part").distinct().count() > 10  # cells in several parts
    assert hits(cell_search(q, index, k=4, n_probe=5)) == sorted(want)


def test_vectors_are_sent_once_whatever_the_number_of_queries(spark):
    t = Tables(spark, SF_SMALL)
    few = fx.label_centroid_queries(t)
    plans = [dense_search(q, t.embeddings, k=5)._jdf.queryExecution().executedPlan().toString()
             for q in (few, few.crossJoin(spark.range(500)).withColumn("query_id", F.col("id") * 1000 + F.col("query_id")))]
    assert all(p.count("hashpartitioning(key") == 1 and "BroadcastNestedLoop" not in p.split("MapInArrow")[0] for p in plans)


def test_cell_index_on_disk(spark, tmp_path):
    t = Tables(spark, SF_MID)
    q = fx.label_centroid_queries(t)
    build_cell_index(t.embeddings, 8, str(tmp_path))
    index = read_cell_index(spark, str(tmp_path))
    assert index.table.count() == t.embeddings.count()
    exact = dense_search(q, t.embeddings, k=10)
    assert hits(cell_search(q, index, k=10, n_probe=8)) == hits(exact)  # probing every cell is exact
    some = probes_for_recall(index, 10, 0.95)
    assert 1 < some < 8 and recall_at_k(cell_search(q, index, k=10, n_probe=some), exact).first()[0] >= 0.9
    assert probes_for_recall(index, 10, 0.2) < some
    few = cell_candidates(q, index, 10, 8).count()
    assert 10 * q.count() <= few < 20 * q.count()  # the bytes leave few of 500 to score exactly
    near = dense._nearest_cells(dense._numbered(q.limit(1), "query_id", "embedding"), index.centers, 2)
    plan = dense._in_cells_of(index, near)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and " IN (" in plan  # files of other cells are not listed


def test_bounds_hold_for_every_vector(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(200, 16)) * rng.choice([1e-3, 1, 1e3], (200, 1))
    vecs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[:20])], "query_id long, embedding array<double>")
    index = build_cell_index(vecs, 3)
    assert hits(cell_search(q, index, k=7, n_probe=3)) == hits(dense_search(q, vecs, k=7))


def test_empty_sides(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert dense_search(q, none).count() == 0
    assert dense_search(none.withColumnRenamed("vec_id", "query_id"), q.withColumnRenamed("query_id", "vec_id")).count() == 0


def test_encoder_hashes_each_word_once_and_counts_every_one(monkeypatch):
    import hashlib as h
    import re

    from searchlane.operators import dense
    texts = ["a b a b a", None, "", "\u00dcber \u00fcber x_y 7", "one two " * 300]

    def plain(t, dim=16):
        out = np.zeros(dim, np.float32)
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            d = h.md5(w.encode()).digest()
            out[int.from_bytes(d[:4], "little") % dim] += 1.0 if d[4] & 1 else -1.0
        n = np.linalg.norm(out)
        return out / n if n else out

    calls = []
    monkeypatch.setattr(dense.hashlib, "md5", lambda b, md5=h.md5: calls.append(b) or md5(b))
    got = dense.HashingEncoder(16).encode(texts)
    assert got.dtype == np.float32 and len(calls) == len(set(calls))
    monkeypatch.undo()
    assert np.allclose(got, [plain(t) for t in texts]) and dense.HashingEncoder(16).encode([]).shape == (0, 16)
