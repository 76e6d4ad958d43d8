import zlib

import numpy as np

from searchlane.llm import op10_logbilinear as o10


def test_context_tells_words_of_one_ending_apart(spark):
    filler = " ".join(f"f{i}" for i in range(300))
    training = f"{filler} {filler} " + "leftxon bigming rightxon smallming " * 2
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % o10.FOLDS != o10.HELD_OUT][:300]
    out = [i for i in range(4000) if zlib.crc32(str(i).encode()) % o10.FOLDS == o10.HELD_OUT][:2]
    seen, turned = "leftxon bigming rightxon smallming", "leftxon smallming rightxon bigming"
    docs = spark.createDataFrame([(i, training) for i in ids] + list(zip(out, (seen, turned))), "doc_id long, text string")
    got = {r.doc_id: r for r in o10.log_bilinear_scores(docs).where("held_out").collect()}
    assert abs(got[out[0]].base_score - got[out[1]].base_score) < 1e-9
    assert got[out[0]].score > got[out[1]].score + 0.05


def make_units(words):
    mass, kinds = np.full(o10.CLASSES, 50.0), np.full(o10.CLASSES, 9.0)
    return o10.Units([f"s{i}".encode() for i in range(255)] + [o10.END], ["ng", "on"], words, mass, kinds, [9] * 256)


def test_probabilities_of_a_class_sum_to_one():
    units = make_units([(b"bigming", 20), (b"smallming", 10), (b"rightxon", 10)])
    inner = o10.Inner(units)
    inner.rows[:] += np.random.default_rng(3).normal(0, 0.5, inner.rows.shape)
    k = o10.SHORTLIST
    p = np.exp(inner.log_probabilities(np.array([[units.total, 3], [0, 256]]), k))
    assert p.shape == (2, 3) and np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_more_distinct_words_give_more_vectors(spark):
    sizes = []
    before = o10.Units.__init__

    def watch(self, *args):
        before(self, *args)
        sizes.append(len(self.number))

    o10.Units.__init__ = watch
    try:
        for n in (1000, 16000):
            docs = spark.createDataFrame([(i, " ".join(f"w{j}q" for j in range(n))) for i in range(3)], "doc_id long, text string")
            o10.log_bilinear_scores(docs).collect()
    finally:
        o10.Units.__init__ = before
    assert 100 < sizes[0] < sizes[1] and sizes[1] > 450
