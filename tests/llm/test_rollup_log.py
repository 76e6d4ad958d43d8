from searchlane.llm import op1_token_rollup as o1
from searchlane.session import scratch_path
from tests.llm.test_rollup_licences_pipeline import CHANGE, totals


def rollup_of(spark, *rows, name="t_rollup"):
    rollup = o1.TokenRollup(spark, scratch_path(spark, name))
    rollup.commit("load", spark.createDataFrame(list(rows), CHANGE))
    return rollup


def test_rollup_keeps_every_row_without_an_id(spark):
    rollup = rollup_of(spark, (None, "insert", "x y", "s", "en"), (None, "insert", "z", "s", "en"),
                       (1, "insert", "a b", "s", "en"), (None, "insert", "q", None, "en"))
    assert totals(rollup) == {("s", "en"): (3, 5), (None, "en"): (1, 1)}
    rollup.commit("more", spark.createDataFrame([(None, "insert", "x y", "s", "en")], CHANGE))
    assert rollup.compact() and not rollup.compact()
    assert totals(rollup) == {("s", "en"): (4, 7), (None, "en"): (1, 1)}
    rollup.commit("gone", spark.createDataFrame(
        [(None, "delete", None, "s", "en"), (None, "insert", "w", "s", "en"), (None, "insert", "w", "s", "de")], CHANGE))
    assert totals(rollup) == {("s", "en"): (1, 2), (None, "en"): (1, 1), ("s", "de"): (1, 1)}


def test_rollup_takes_one_row_a_document_in_all_versions(spark):
    rollup = rollup_of(spark, (1, "insert", "a.b.c d", "s", "en"), (1, "insert", "e f g", "t", "en"))
    # alnum-runs-1 is compared first: 4 runs against 3
    assert {(r.source, r.tokenizer, r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == {
        ("s", "alnum-runs-1", 1, 4), ("s", "space-words-1", 1, 2)}
    changes = [(1, "insert", "a", "s", "en", 3), (1, "delete", None, "s", "en", 2), (1, "revise", "a b c", "s", "en", 1)]
    rollup.commit("ordered", spark.createDataFrame(changes, CHANGE + ", seq long"), order="seq")
    assert totals(rollup) == {("s", "en"): (1, 1)}


def test_rollup_batch_committed_during_a_fold_counts_once(spark, monkeypatch):
    rollup = rollup_of(spark, (1, "insert", "a b c", "s", "en"), (2, "insert", "d", "s", "en"))
    other = o1.TokenRollup(spark, rollup.path)
    late = spark.createDataFrame([(3, "insert", "e f g", "s", "en")], CHANGE)
    read = rollup._read

    def read_after_commit(*args):
        other.commit("late", late)
        return read(*args)

    monkeypatch.setattr(rollup, "_read", read_after_commit)
    assert rollup.compact()
    monkeypatch.undo()
    assert totals(rollup) == {("s", "en"): (3, 7)} and rollup.committed() == ["load", "late"]


def test_rollup_commits_are_ordered(spark, monkeypatch):
    rollup = rollup_of(spark, (1, "insert", "a b c", "s", "en"))
    other = o1.TokenRollup(spark, rollup.path)
    publish = rollup._publish

    def publish_second(*args):
        other.commit("first/..", spark.createDataFrame([(1, "revise", "a b c d e", "s", "en")], CHANGE))
        return publish(*args)

    monkeypatch.setattr(rollup, "_publish", publish_second)
    assert rollup.commit("second", spark.createDataFrame([(1, "revise", "a", "s", "en")], CHANGE))
    monkeypatch.undo()
    assert totals(rollup) == {("s", "en"): (1, 1)} and rollup.committed() == ["load", "first/..", "second"]
    assert not other.commit("second", spark.createDataFrame([(1, "delete", None, "s", "en")], CHANGE))
