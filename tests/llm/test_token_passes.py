import numpy as np
import pyarrow as pa

from searchlane.llm import op10_logbilinear as o10


def test_a_pass_looks_each_distinct_word_up_once():
    texts = pa.array(["Ab ab\tx\x1cy  \n", None, "", " AB Äb c", "x\x1cy\x0bab\x0c"])
    words, code, lengths = o10.tokens(texts)
    whole = words.to_pylist()
    assert sorted(whole) == sorted(["ab", "x\x1cy", "Äb c", o10.END.decode()])
    assert [whole[i] for i in code] == ["ab", "ab", "x\x1cy", " ", " ", " ", "ab", "Äb c", " ", "x\x1cy", "ab", " "]
    assert lengths.tolist() == [4, 1, 1, 3, 3]


def test_partial_counts_are_passed_on_within_a_bound(monkeypatch):
    monkeypatch.setattr(o10, "COUNTER_WORDS", 40)
    monkeypatch.setattr(o10.textkit.chunks, "__defaults__", (60,))
    texts = [f"same w{i} w{i % 7} last{i}" for i in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[lo:lo + 50])], ["text"]) for lo in range(0, 200, 50)]
    total, sizes = {}, []
    for batch in o10._partial_counts(batches):
        assert batch.schema.types == [pa.string(), pa.int64()]
        sizes.append(batch.num_rows)
        for row in batch.to_pylist():
            total[row["word"]] = total.get(row["word"], 0) + row["c"]
    want = {}
    for t in texts:
        for w in t.split() + [o10.END.decode()]:
            want[w] = want.get(w, 0) + 1
    assert total == want and len(sizes) > 5 and max(sizes) <= 60


def test_units_of_distinct_words():
    mass, kinds = np.full(o10.CLASSES, 50.0), np.full(o10.CLASSES, 9.0)
    short = [f"s{i}".encode() for i in range(255)] + [o10.END]
    units = o10.Units(short, ["ng", "äx"], [(b"bigming", 20), (b"other", 9)], mass, kinds, [9] * 256)
    words = pa.array(["s3", "bigming", "small-ng", "bäx", "x", " ", "other", "rest"])
    got = units.units_of(words).tolist()
    rest = units.rest
    assert got == [rest[3], units.number[b"bigming"], rest[256], rest[257], rest[-1], rest[255], units.number[b"other"], rest[-1]]
    contexts, target = o10.unit_rows(words, np.array([0, 1, 5, 5, 2, 5]), np.array([3, 1, 2]), units)
    none, a, b, end = units.total, rest[3], units.number[b"bigming"], rest[255]
    assert target.tolist() == [a, b, end, end, rest[256], end]
    assert contexts.tolist() == [[none, none], [none, a], [a, b], [none, none], [none, none], [none, rest[256]]]


def test_sums_and_exponentials():
    rng = np.random.default_rng(1)
    at, rows = rng.integers(0, 9, 500).astype(np.uint16), rng.normal(size=(500, o10.DIM)).astype(np.float32)
    want = np.zeros((9, o10.DIM))
    np.add.at(want, at, rows)
    keys, sums, n = o10._sums(at, rows)
    assert keys.tolist() == sorted(set(at.tolist())) and np.allclose(sums, want[keys], atol=1e-4)
    assert n.tolist() == np.bincount(at)[keys].tolist()
    for far in (0, 400):  # rows that lie so far apart that one shift would make one of them vanish
        z = (rng.normal(size=(3, 5)) + np.array([[0], [far], [-far]])).astype(np.float32)
        shift, total = o10._exponentials(z.copy())
        assert np.allclose(shift + np.log(total), np.logaddexp.reduce(z.astype(float), axis=1), atol=1e-3)
