import collections

from searchlane.llm import op8_mix_sources as o8

P = 2147483647
DOC = "doc_id long, text string, source string"


def brute_counts(slots, shard):
    """{(shard, stream): slots} of the residual multinomial draw."""
    total, out = sum(slots.values()), collections.Counter()
    for j in range(-(-total // shard)):
        room = min(shard, total - j * shard)
        rest = {}
        for s in sorted(slots):
            out[j, s] += room * slots[s] // total
            rest[s] = room * slots[s] % total
        every = sum(rest.values())
        for i in range(every // total):
            halves = []
            for salt in (24680, 13579):
                v = ((j % P + 3) * 48271 + (i + 1) * 69621 + salt) % P
                v = (v * v + salt) % P
                halves.append((v * v + i) % P)
            u = (halves[0] * P + halves[1]) % every
            for s in sorted(rest):
                if u < rest[s]:
                    out[j, s] += 1
                    break
                u -= rest[s]
    return {k: n for k, n in out.items() if n}


def test_counts_of_shards_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(o8, "SPAN", 3)
    slots = {0: 331, 1: 97, 2: 53, 3: 1, 4: 0, 5: 7}
    sources = spark.createDataFrame(list(slots.items()), "stream long, slots long")
    rows = o8.draw_counts(sources, shard=16).collect()
    want = brute_counts({s: n for s, n in slots.items() if n}, 16)
    assert {(r.out_shard, r.stream): r.n for r in rows} == want
    seen = collections.Counter()
    for r in sorted(rows, key=lambda r: r.out_shard):
        assert r["first"] == seen[r.stream]
        seen[r.stream] += r.n
    by_shard = collections.Counter()
    for r in rows:
        by_shard[r.out_shard] += r.n
    assert sum(seen.values()) == 489 and set(list(by_shard.values())[:-1]) <= {16, 9}
    assert max(abs(seen[s] - n) for s, n in slots.items()) > 0  # the draw decides


def test_no_block_is_taken_three_times_and_places_are_distinct(spark):
    rows = [(0, 20, 40), (1, 300, 250), (2, 7, 14), (3, 90, 33)]
    sources = (spark.createDataFrame(rows, "stream long, blocks long, slots long")
               .withColumn("keys", o8.round_keys(o8.F.col("stream"))))
    got = o8.draw(sources, shard=16).toPandas()
    assert got.groupby(["stream", "block"]).size().max() <= 2
    assert not got.duplicated(["out_shard", "out_place"]).any() and not got.duplicated(["stream", "slot"]).any()
    assert (got.block < got.stream.map({s: b for s, b, _ in rows})).all()
    taken = got.groupby("stream").size()
    assert all(abs(taken[s] - n) <= 2 * 22 ** 0.5 for s, _, n in rows)


def test_places_of_sparse_and_repeated_ids(spark):
    docs = [(i * 10 ** 15 + 7, f"d{i} " * (i % 5), "hot") for i in range(40)]
    docs += [(5, "x y", "hot")] * 3 + [(5, "other text", "hot"), (5, "x y", "b"), (None, "n o", "hot"), (None, "p", "hot")]
    sizes = o8.pack(spark.createDataFrame(docs, DOC)).drop("start")
    for part in (1, 7, 1000):
        rows = o8.place(sizes, part=part).collect()
        for source in ("hot", "b"):
            at = 0
            mine = sorted((r for r in rows if r.source == source), key=lambda r: (r.start, r["size"]))
            for r in mine:
                assert r.start == at
                at += r["size"]
            ids = [r.doc_id for r in mine if r["size"]]
            assert ids == sorted(ids, key=lambda i: (i is None, i))


def test_blocks_of_repeated_and_null_ids_hold_every_word_once(spark):
    docs = [(1, "a b c", "s"), (1, "d e f g", "s"), (1, "a b c", "s"), (None, "h i j k", "s"), (None, "l m", "s"),
            (2, "n o", "s"), (1, "z z", None), (None, "y y y", None), (3, None, "s"), (None, None, None)]
    df = spark.createDataFrame(docs, DOC)
    rows = o8.mixed_blocks(df, block=4).toPandas()
    first = rows.assign(source=rows.source.fillna("-")).drop_duplicates(["source", "block"])
    for source, want in (("s", "a b c a b c d e f g h i j k l m n o"), ("-", "y y y z z")):
        words = " ".join(first[first.source == source].text).split()
        assert sorted(words) == sorted(want.split())
    assert rows.text.str.split().str.len().sum() == o8.mix(df, block=4).toPandas().taken.sum()
