import random
import re

import pytest

from searchlane.llm import op12_divergence_audit as o12
from tests.conftest import SF_SMALL


def brute(docs, top=200):
    """Every row of the audit, by dictionaries and sorts."""
    used, held, groups = {}, {}, set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        for w in words:
            used[lang, source, w] = used.get((lang, source, w), 0) + 1
        for w in set(words):
            held[lang, w] = held.get((lang, w), 0) + 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (x, w), n in held.items() if x == lang and n >= 3)
        sources = sorted(s for x, s in groups if x == lang)
        count = {s: {w: used.get((lang, s, w), 0) for w in kept} for s in sources}
        count[None] = {w: sum(count[s][w] for s in sources) for w in kept}
        size = {s: sum(c.values()) + len(kept) for s, c in count.items()}
        p = {s: {w: 1 + 10 ** 9 * (n + 1) // size[s] for w, n in c.items()} for s, c in count.items()}
        for s in sources:
            rows = {"pair": [(t, sum((p[s][w] - p[t][w]) ** 2 // p[t][w] for w in kept)) for t in sources if t != s],
                    "term": [(w, (p[s][w] - p[None][w]) ** 2 // p[None][w]) for w in kept
                             if count[s][w] and p[s][w] > p[None][w]]}
            for part, found in rows.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def audit(docs, **options):
    return sorted(map(tuple, o12.audit(docs, **options).collect()))


def test_query_matches_brute_force(spark, small_docs):
    got = sorted(map(tuple, o12.op12_divergence_audit(spark, SF_SMALL).collect()))
    assert got == brute([tuple(r) for r in small_docs.select("lang", "source", "text").collect()])
    assert {r[2] for r in got} == {"pair", "term"} and max(r[4] for r in got) > 0


@pytest.mark.parametrize("groups, columns, terms", [(32, 1024, 4096), (2, 9, 5), (3, 1, 4096), (32, 1024, 1)])
def test_blocks_of_any_size_give_the_same_sums(spark, monkeypatch, groups, columns, terms):
    rng = random.Random(3)
    docs = [(rng.choice("xy"), f"s{rng.randrange(7)}", " ".join(
        rng.choice("a b c d e f g h i j k l m n o p É ñ".split()) * rng.randrange(1, 3) for _ in range(rng.randrange(60))))
        for _ in range(60)] + [("z", "only", "one two")]
    frame = spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)
    for name, value in (("GROUPS", groups), ("COLUMNS", columns), ("TERMS", terms)):
        monkeypatch.setattr(o12, name, value)

    # mapInArrow runs in other processes: the block itself is compared here
    terms_of = o12.kept_terms(frame)
    sizes = o12.group_sizes(frame, terms_of)
    got = {}
    for lang in "xyz":
        of = sorted((r.source, r.base) for r in sizes.collect() if r.lang == lang and r.source is not None)
        block = o12.Block([s for s, _ in of], [b for _, b in of])
        for r in sorted((r for r in terms_of.collect() if r.lang == lang), key=lambda r: r.total):
            block.add([(u.source, u.n) for u in r.uses])
        got |= {(lang, s, t): v for s, t, v in block.values()}
    want = brute(docs)
    assert got == {(r[0], r[1], r[3]): r[4] for r in want if r[2] == "pair"}
    assert audit(frame) == want


def test_parts_and_counts_beyond_32_bits(spark):
    """Counts whose products pass 64 bits stay exact, in blocks and in columns."""
    big = 10 ** 13
    terms = spark.createDataFrame(
        [("x", "a", 2 * big, [("s", big), ("t", big)]), ("x", "b", big + 3, [("s", 3), ("t", big)])],
        "lang string, term string, total long, uses array<struct<source:string,n:long>>")
    groups = spark.createDataFrame([("x", "s", big + 5), ("x", "t", 2 * big + 2), ("x", None, 3 * big + 5)],
                                   "lang string, source string, base long")

    def p(n, base):
        return 1 + 10 ** 9 * (n + 1) // base

    ps, pt = [p(n, big + 5) for n in (big, 3)], [p(big, 2 * big + 2)] * 2
    want = {("s", "t"): sum((x - y) ** 2 // y for x, y in zip(ps, pt)), ("t", "s"): sum((y - x) ** 2 // x for x, y in zip(ps, pt))}
    for part_terms in (1, 100):
        got = {(r.source, r.item): r.value for r in o12.source_pairs(terms, groups, part_terms).collect()}
        assert got == want
    top = {(r.source, r.item): r.value for r in o12.source_terms(terms, groups).collect()}
    q = [p(2 * big, 3 * big + 5), p(big + 3, 3 * big + 5)]
    assert top == {("s", "a"): (ps[0] - q[0]) ** 2 // q[0], ("t", "b"): (pt[1] - q[1]) ** 2 // q[1]}


def test_odd_rows(spark, odd_docs, no_docs):
    assert audit(odd_docs) == brute([tuple(r) for r in odd_docs.select("lang", "source", "text").collect()])
    assert audit(no_docs) == []
    few = spark.createDataFrame([("x", "s", "one"), ("x", "t", "two"), (None, None, None)],
                                "lang string, source string, text string")
    assert audit(few) == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]


def test_pieces_of_a_long_text():
    text = ("Ab cd1ef, É-x " * 9).encode()
    want = text.translate(o12.FOLD).split()
    for piece in (1, 3, 10, 1 << 20):
        assert [w for words in o12._words(text, piece) for w in words] == want
