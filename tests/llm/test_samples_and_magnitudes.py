import math

from searchlane.llm import op4_rule_quality as o4
from searchlane.llm import op6_prefix_forest as o6
from searchlane.llm.labels import training_sample

DOC = "doc_id long, text string"


def test_a_repeated_labelled_id_brings_one_row(spark):
    docs = spark.range(5000).selectExpr("id % 5 AS doc_id", "concat('t', id) AS text").unionByName(
        spark.createDataFrame([(5, None), (5, None), (None, "n")], DOC))
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)] + [(1, 0), (3, None), (None, 1)], "doc_id long, quality int")
    rows = training_sample(docs, labels, "quality", 3, 9, 100).collect()
    largest = {i: "t" + max(map(str, range(i, 5000, 5))) for i in range(5)}
    assert sorted((r.doc_id, r.y, r.text) for r in rows if r.doc_id != 5) == [(i, i % 2, largest[i]) for i in range(5)]
    assert [(r.y, r.text) for r in rows if r.doc_id == 5] == [(1, None)]
    out = o4.quality(docs, labels)
    assert out.count() == docs.count()


def test_tiny_and_huge_vectors_have_their_cosine(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [3e-200, 4e-200]), (3, [5e-324, 0.0]), (50, [1.0, 0.0]), (51, [-1e308, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = o6.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    for q, same in ((0, 50), (50, 0)):
        mine = [(r.vec_id, r.score) for r in got if r.query_id == q]
        assert [v for v, _ in mine] == [min(same, 3), max(same, 3), 1, 2, 51]
        want = {same: 1.0, 3: 1.0, 1: math.sqrt(0.5), 2: 0.6, 51: -1.0}
        assert all(abs(s - want[v]) < 1e-12 for v, s in mine)
