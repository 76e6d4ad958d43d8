import pytest

from searchlane.operators import batching as BT


def test_karmarkar_karp_covers_each_item_once():
    lens = [9, 7, 6, 5, 5, 4, 3, 2, 2, 1, 8, 3]
    for equal in (True, False):
        parts = BT.karmarkar_karp(lens, 4, equal)
        flat = sorted(i for p in parts for i in p)
        assert flat == list(range(len(lens)))
        if equal:
            assert all(len(p) == 3 for p in parts)
        sums = [sum(lens[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= max(lens)
    with pytest.raises(ValueError):
        BT.karmarkar_karp([1, 2, 3], 2, True)


def test_greedy_partition():
    assert BT.greedy_partition([5, 1, 1, 1], 2) == [[0], [1, 2, 3]]


def test_balance_partitions_distributed(spark):
    df = spark.createDataFrame([(b, i, (i * 7) % 11 + 1) for b in range(3) for i in range(8)],
                               "batch_id long, row_idx long, seqlen int")
    a = BT.balance_partitions(df, 4, equal_size=True)
    assert a.count() == 24 and a.select("batch_id", "row_idx").distinct().count() == 24
    assert all(r["count"] == 2 for r in a.groupBy("batch_id", "partition_id").count().collect())


def test_row_index_repeat_and_pad(spark):
    df = spark.createDataFrame([(k,) for k in (5, 3, 9, 1, 7)], "k int")
    idx = BT.with_row_index(df, ["k"])
    assert [r["k"] for r in idx.orderBy("row_idx").collect()] == [1, 3, 5, 7, 9]
    padded = BT.pad_to_divisor(idx, 4)
    assert padded.count() == 8 and padded.filter("is_pad").count() == 3
    rep = BT.repeat_rows(idx, 2, interleave=False).orderBy("repeat_order").collect()
    assert [(r["rep"], r["row_idx"]) for r in rep[:3]] == [(0, 0), (0, 1), (0, 2)]
    with pytest.raises(ValueError):
        BT.chunk(idx, 2)


def test_row_index_is_dense_over_many_columns_and_partitions(spark):
    li = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    n, keep = li.count(), {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for adaptive, parts in (("true", "8"), ("true", "200"), ("false", "8"), ("false", "200")):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            idx = BT.with_row_index(li, ["l_shipdate", "l_orderkey", "l_linenumber"])
            row = idx.selectExpr("count(*)", "count(distinct row_idx)", "min(row_idx)", "max(row_idx)").first()
            assert tuple(row) == (n, n, 0, n - 1), (adaptive, parts)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_slice_rows_and_exact_sample_use_the_index(spark):
    from searchlane.operators import datasets as DS
    df = spark.range(1000).withColumnRenamed("id", "k").repartition(17)
    assert sorted(r.k for r in DS.slice_rows(df, ["k"], 100, 50).collect()) == list(range(100, 150))
    assert sorted(r.k for r in DS.slice_rows(df, ["k"], 990).collect()) == list(range(990, 1000))
    assert DS.sample_exact(df, 37, "k").count() == 37


def test_snake_batches_balance_every_batch(spark):
    rows = [(i // 20, i, 1 + i * 7919 % 97) for i in range(50)]
    df = spark.createDataFrame(rows, "batch_id long, row_idx long, seqlen int")
    got = {(r.batch_id, r.row_idx): r.partition_id for r in BT.snake_batches(df, 4).collect()}
    assert len(got) == 50 and set(got.values()) == {0, 1, 2, 3}
    for b in range(3):
        sums, sizes = [0] * 4, [0] * 4
        for batch, i, n in rows:
            if batch == b:
                sums[got[b, i]] += n
                sizes[got[b, i]] += 1
        assert max(sizes) - min(sizes) <= 1 and max(sums) - min(sums) <= 97
