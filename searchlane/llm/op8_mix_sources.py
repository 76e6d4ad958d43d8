"""Mixing sources to target weights, with DataFrame and SQL functions only.

1. *Pack.* The documents of a source, in doc_id order, form one stream of words cut into
   blocks of ``BLOCK`` words. The sizes are range-sorted by source and id into parts of
   about ``PART`` rows and written; stream positions are running sums inside a part, whose
   number follows the rows whatever the ids look like, and over the totals of the parts.
2. *Targets.* Sources by code point (null last) weigh 5, 2, 1, repeating, and share
   ``BUDGET`` times all words; a target stops at twice its source and the excess is shared
   again. The level at which that settles is one running sum over the sources.
3. *Draw.* The mixture has as many slots as blocks fit the targets, dealt to output shards
   of ``SHARD`` slots. Every shard draws its source counts: a source gets the whole part of
   its expected count, and the slots left over, fewer than there are sources, are drawn
   multinomially by the fractions (residual multinomial draw), from a seeded hash of shard
   and draw.
4. *Take.* A source's slots, numbered through the shards, run through a pseudorandom
   permutation of its block indices, again from the start once all blocks are used, and
   blocks join slots by index. Slots beyond twice the blocks of a source stay empty, so a
   block is taken at most twice, and so is every document.

A source's slots differ from its target by less than one a shard downwards and by fewer
than the number of sources a shard upwards, with a standard deviation of at most half the
root of the slots left over in all shards; a mixture of one shard meets its targets to a
block. Independent draws of all slots would miss small sources by their sampling noise.

Permutations are swap-or-not networks (Hoang, Morris and Rogaway, 2012) on exactly n
indices, in integer arithmetic: nothing is drawn at run time, so reruns agree.

Defined cases: null and empty texts have size 0 and are never taken; a null source is the
last source; null ids go last and are ordered by text; rows that repeat an id follow each
other; without words every target is 0; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlane.llm import scratch
from searchlane.llm.textkit import SPACES
from searchlane.operators.common import bounded_broadcast

BLOCK = 128
SHARD = 1024  # slots of an output shard, more if there are more sources
SLOTS = 131_072  # slots a task deals out
SPAN = 1024  # shards whose counts one running sum adds up
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
PART = 1_000_000  # rows of a part of the range sort
ROUNDS = 24
PRIME = 2147483647
MAX_SOURCES = 100_000  # sources that are broadcast; beyond, the joins shuffle


def n_words(text: Column) -> Column:
    """Number of words: each becomes one letter, white space goes."""
    marks = F.regexp_replace(text, f"[^{SPACES}]+", "w")
    return F.coalesce(F.length(F.regexp_replace(marks, f"[{SPACES}]+", "")), F.lit(0)).cast("long")


def round_keys(stream: Column) -> Column:
    """Keys (k, a) of every round of the permutation that belongs to ``stream``."""
    p = F.lit(PRIME).cast("long")

    def scrambled(r: Column, salt: int) -> Column:
        v = ((stream + 2) * 48271 + (r + 1) * 69621 + salt) % p
        return (v * v) % p

    rounds = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))
    return F.transform(rounds, lambda r: F.struct(scrambled(r, 12345).alias("k"),
                                                  (scrambled(r, 987654321) + 1).alias("a")))


def permuted(x: Column, n: Column, keys: Column) -> Column:
    """Image of ``x`` under the permutation of 0..n-1 that ``keys`` define.

    A round pairs x with k - x (mod n) and swaps them if a bit of a hash of the larger
    one, (a * larger + k) mod a prime, is set: each round is its own inverse."""
    p = F.lit(PRIME).cast("long")

    def step(acc: Column, key: Column) -> Column:
        other = F.pmod(key["k"] - acc, n)
        hashed = ((F.greatest(acc, other) % p) * key["a"] + key["k"]) % p
        return F.when(F.shiftright(hashed, 15).bitwiseAND(1) == 1, other).otherwise(acc)

    return F.aggregate(keys, x.cast("long"), step)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, stream, target) of a table (source, size) with one row a source.

    One window over the sources: a dimension table with a row a source, not a row a
    document. A source is held at twice its size if the level that just fills it asks
    for less than the budget in total."""
    every = Window.partitionBy(F.lit(0))
    up_to = every.orderBy("ratio").rangeBetween(Window.unboundedPreceding, 0)
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("stream") % len(WEIGHTS) + 1).cast("int"))
    total = F.sum("source_size").over(every) * BUDGET
    out = (sizes.withColumn("stream", rank.cast("long")).withColumn("w", weight.cast("double"))
           .withColumn("cap", F.col("source_size") * MOST).withColumn("ratio", F.col("cap") / F.col("w"))
           .withColumn("all", total)
           .withColumn("held", F.sum("cap").over(up_to)
                       + F.col("ratio") * (F.sum("w").over(every) - F.sum("w").over(up_to)) < F.col("all"))
           .withColumn("free", F.sum(F.when(F.col("held"), 0.0).otherwise(F.col("w"))).over(every))
           .withColumn("left", F.col("all") - F.sum(F.when(F.col("held"), F.col("cap")).otherwise(0.0)).over(every)))
    return out.select("source", "source_size", "stream",
                      F.when(F.col("held"), F.col("cap")).otherwise(
                          F.col("left") * F.col("w") / F.col("free")).alias("target"))


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def pack(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, start): where each document lies in its source's stream."""
    text = F.col("text").cast("string")
    sizes = scratch.store(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        n_words(text).alias("size"), F.xxhash64(text).alias("tie")), "mix_sizes")
    return place(sizes)


def place(sizes: DataFrame, part: int = PART) -> DataFrame:
    """(doc_id, source, size, tie, start) of a table (doc_id, source, size, tie)."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("size")]
    parts = max(1, -(-sizes.count() // part))
    # the part is written with the rows: it is read from the table, not planned again
    sizes = scratch.store(sizes.repartitionByRange(parts, F.col("source"), *order)
                          .withColumn("part", F.spark_partition_id()), "mix_parts")

    def ahead(n: str, window) -> Column:
        return F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    offsets = (sizes.groupBy("source", "part").agg(F.sum("size").alias("n"))
               .select(F.col("source").alias("of"), F.col("part").alias("p"),
                       ahead("n", Window.partitionBy("source").orderBy("part")).alias("offset")))
    return (sizes.withColumn("run", ahead("size", Window.partitionBy("source", "part").orderBy(*order)))
            .join(offsets, _same(F.col("source"), F.col("of")) & (F.col("part") == F.col("p")))
            .select("doc_id", "source", "size", "tie", (F.col("offset") + F.col("run")).alias("start")))


def plan_sources(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Targets with the number of blocks and slots of every source, and where its slots begin."""
    sizes = packed.groupBy("source").agg(F.sum("size").alias("source_size"))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    slots = F.when(F.col("source_size") > 0, F.least(
        F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long"), F.col("blocks") * 2)
    ).otherwise(0).cast("long")
    return (targets(sizes).withColumn("blocks", blocks).withColumn("slots", slots)
            .withColumn("keys", round_keys(F.col("stream"))))


def uniform(shard: Column, i: Column, below: Column) -> Column:
    """A pseudorandom number under ``below`` for draw ``i`` of a shard: two hashes of 31 bits."""
    p = F.lit(PRIME).cast("long")

    def half(salt: int) -> Column:
        v = ((shard % p + 3) * 48271 + (i + 1) * 69621 + salt) % p
        v = (v * v + salt) % p
        return (v * v + i) % p

    return (half(24680) * p + half(13579)) % below


def draw_counts(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """(out_shard, stream, n, first): the slots of every source in every output shard and the
    number of its slots in the shards before, by a residual multinomial draw a shard."""
    spark = sources.sparkSession
    total, many = sources.where("slots > 0").agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    shard = max(shard, many)  # so that rows of (shard, source) are no more than slots
    shards = -(-total // shard)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards * many // 1_000_000)
    # spans of shards first, dealt out, then their shards: few small rows, so their number of tasks is set here
    spans = (sources.where("slots > 0").select("stream", "slots")
             .withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(max(shards - 1, 0) // SPAN))))
             .repartition(tasks, "stream", "span"))
    every = (spans.withColumn("out_shard", F.explode(F.sequence(
        (F.col("span") * SPAN).cast("long"), F.least((F.col("span") + 1) * SPAN, F.lit(shards)).cast("long") - 1)))
        .withColumn("room", F.least(F.lit(shard), F.lit(total) - F.col("out_shard") * shard).cast("long")))
    # expected counts room * slots / total in whole numbers: whole part and rest
    rests = (every.withColumn("whole", F.expr(f"room * slots div {max(total, 1)}"))
             .withColumn("rest", F.expr(f"room * slots % {max(total, 1)}")))
    in_shard = Window.partitionBy("out_shard")
    upto = F.sum("rest").over(in_shard.orderBy("stream").rowsBetween(Window.unboundedPreceding, 0))
    bounds = (rests.withColumn("upto", upto).withColumn("every", F.sum("rest").over(in_shard)))
    drawn = (bounds.groupBy("out_shard").agg(F.max("every").alias("every")).where("every > 0")
             .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"every div {max(total, 1)} - 1"))))
             .select("out_shard", uniform(F.col("out_shard"), F.col("i"), F.col("every")).alias("u")))
    # a draw falls to the first source whose upper bound exceeds it: one order of draws and bounds a shard
    mixed = (drawn.select("out_shard", F.col("u").alias("x"), F.lit(1).alias("late"), F.lit(None).cast("long").alias("stream"))
             .unionByName(bounds.where("rest > 0").select("out_shard", F.col("upto").alias("x"), F.lit(0).alias("late"), "stream")))
    above = in_shard.orderBy(F.desc("x"), F.desc("late")).rowsBetween(Window.unboundedPreceding, -1)
    hits = (mixed.withColumn("falls", F.last("stream", ignorenulls=True).over(above)).where("late = 1")
            .groupBy("out_shard", F.col("falls").alias("stream")).agg(F.count(F.lit(1)).alias("extra")))
    counts = scratch.store(rests.join(hits, ["out_shard", "stream"], "left").select(
        "out_shard", "stream", "span", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("n")), "mix_counts")

    def ahead(keys: list, by: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(by)
                                          .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    spans = (counts.groupBy("stream", "span").agg(F.sum("n").alias("n"))
             .select("stream", "span", ahead(["stream"], "span").alias("before")))
    return (counts.withColumn("run", ahead(["stream", "span"], "out_shard")).join(spans, ["stream", "span"])
            .select("out_shard", "stream", "n", (F.col("before") + F.col("run")).alias("first")).where("n > 0"))


def draw(sources: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row a slot that is filled: stream, slot, block (index in the source), out_shard and out_place."""
    in_shard = Window.partitionBy("out_shard")
    counts = (draw_counts(sources, shard)
              .withColumn("room", F.sum("n").over(in_shard))
              .withColumn("at", F.sum("n").over(in_shard.orderBy("stream").rowsBetween(Window.unboundedPreceding, 0))
                          - F.col("n")))
    own = bounded_broadcast(sources.select("stream", "blocks", "keys"), MAX_SOURCES)
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    # counts are few small rows and the slots they stand for many: their number of tasks is set here
    tasks = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SLOTS)
    slots = (counts.join(own, "stream").repartition(tasks, "out_shard", "stream")
             .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
             .withColumn("slot", F.col("first") + F.col("i")).where("slot < 2 * blocks"))
    return slots.select(
        "stream", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("keys")).alias("block"),
        "out_shard", permuted(F.col("at") + F.col("i"), F.col("room"), round_keys(F.col("out_shard"))).alias("out_place"))


def pieces(packed: DataFrame, block: int = BLOCK, *more: str) -> DataFrame:
    """One row a document and block that share words: at, the first shared word of the
    document, and n, their number."""
    end = F.col("start") + F.col("size")
    cut = packed.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    first = F.greatest("start", F.col("block") * block)
    return cut.select("source", "size", "start", "block", (first - F.col("start")).alias("at"),
                      (F.least(end, (F.col("block") + 1) * block) - first).alias("n"), *more)


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a row of ``docs``: doc_id, source, size, source_size, target, taken."""
    packed = scratch.store(pack(docs), "mix_packed")
    sources = scratch.store(plan_sources(packed, block), "mix_sources")
    # a table, whose size the planner knows: it takes exploded slots for the few rows they come from
    # and would broadcast them; the table too, whose file holds a few bytes a row
    times = scratch.store(draw(sources).groupBy("stream", "block").agg(F.count(F.lit(1)).alias("times")), "mix_times")
    known = bounded_broadcast(sources.select(F.col("source").alias("of"), "stream", "source_size", "target"),
                              MAX_SOURCES)
    keyed = packed.join(known, _same(F.col("source"), F.col("of"))).drop("of")
    taken = (pieces(keyed.select(F.col("stream").alias("source"), "size", "start"), block)
             .withColumnRenamed("source", "stream").join(times.hint("merge"), ["stream", "block"])
             .groupBy("stream", "start").agg(F.sum(F.col("n") * F.col("times")).alias("taken")))
    return (keyed.withColumn("at", F.when(F.col("size") > 0, F.col("start")))
            .join(taken.withColumnRenamed("stream", "s").withColumnRenamed("start", "b"),
                  (F.col("stream") == F.col("s")) & (F.col("at") == F.col("b")), "left")
            .select("doc_id", "source", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixture itself: out_shard, out_place, source, block and the block's text."""
    packed = scratch.store(pack(docs), "mix_packed")
    sources = scratch.store(plan_sources(packed, block), "mix_sources")
    text = F.col("text").cast("string")
    words = docs.select(
        F.col("doc_id").cast("long").alias("i"), F.col("source").cast("string").alias("of"), F.xxhash64(text).alias("t"),
        F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+"), lambda w: w != "").alias("words"))
    # rows of one id, source and text hold the same words: one of them serves all their places
    words = words.groupBy("i", "of", "t").agg(F.max("words").alias("words"))
    texts = (pieces(packed.join(words, _same(F.col("doc_id"), F.col("i")) & _same(F.col("source"), F.col("of"))
                                & (F.col("tie") == F.col("t"))), block, "words")
             .groupBy("source", "block")
             .agg(F.array_sort(F.collect_list(F.struct(
                 "start", F.slice("words", (F.col("at") + 1).cast("int"), F.col("n").cast("int")).alias("w")))).alias("p"))
             .select(F.col("source").alias("of"), F.col("block").alias("b"),
                     F.array_join(F.flatten(F.col("p.w")), " ").alias("text")))
    drawn = scratch.store(draw(sources).join(sources.select("stream", "source"), "stream"), "mix_slots")
    return (drawn.join(texts, _same(F.col("source"), F.col("of")) & (F.col("block") == F.col("b")))
            .select("out_shard", "out_place", "source", "block", "text"))


def op8_mix_sources(spark, sf_dir):
    """Op 8 over the whole ``documents`` table."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


_KEY = "(((stream + 2) * 48271 + (r + 1) * 69621 + {0}) % 2147483647)"
_K = f"({_KEY.format(12345)} * {_KEY.format(12345)} % 2147483647)"
_A = f"({_KEY.format(987654321)} * {_KEY.format(987654321)} % 2147483647 + 1)"
_OTHER = f"((({_K} - x) % blocks + blocks) % blocks)"
_BIT = f"((((greatest(x, {_OTHER}) % 2147483647) * {_A} + {_K}) % 2147483647) >> 15) & 1"
_V = "(((d.out_shard % 2147483647 + 3) * 48271 + (d.i + 1) * 69621 + {0}) % 2147483647)"
_HALF = f"((({_V} * {_V} + {{0}}) % 2147483647) * (({_V} * {_V} + {{0}}) % 2147483647) + d.i) % 2147483647"

ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
           FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS stream FROM s0),
s2 AS (SELECT *, ([5, 2, 1])[stream % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap,
              (sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE AS total FROM s1),
s3 AS (SELECT *, cap / w AS ratio FROM s2),
s4 AS (SELECT *, sum(cap) OVER (ORDER BY ratio) + ratio * (sum(w) OVER () - sum(w) OVER (ORDER BY ratio)) < total
              AS held FROM s3),
s5 AS (SELECT *, sum(CASE WHEN held THEN 0.0::DOUBLE ELSE w END) OVER () AS free,
              total - sum(CASE WHEN held THEN cap ELSE 0.0::DOUBLE END) OVER () AS rest FROM s4),
s6 AS (SELECT source, source_size, stream, CASE WHEN held THEN cap ELSE rest * w / free END AS target,
              ceil(source_size / 128.0)::BIGINT AS blocks FROM s5),
s AS (SELECT *, CASE WHEN source_size > 0
                     THEN least(floor(target * blocks / source_size + 0.5)::BIGINT, blocks * 2) ELSE 0 END AS slots
      FROM s6),
placed AS (SELECT doc_id, source, size,
                  (sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start
           FROM d),
size AS (SELECT sum(slots)::BIGINT AS total, greatest({SHARD}, count(*))::BIGINT AS shard FROM s WHERE slots > 0),
shards AS (SELECT out_shard, least(shard, total - out_shard * shard) AS room, total
           FROM (SELECT *, unnest(range((total + shard - 1) // shard)) AS out_shard FROM size)),
rests AS (SELECT out_shard, stream, room * slots // total AS whole, room * slots % total AS rest, total
          FROM shards, s WHERE slots > 0),
bounds AS (SELECT *, (sum(rest) OVER (PARTITION BY out_shard ORDER BY stream))::BIGINT AS upto,
                  (sum(rest) OVER (PARTITION BY out_shard))::BIGINT AS every FROM rests),
draws AS (SELECT out_shard, every, unnest(range(every // total)) AS i
          FROM (SELECT DISTINCT out_shard, every, total FROM bounds)),
hits AS (SELECT d.out_shard, d.i, min(b.stream) AS stream
         FROM draws d JOIN bounds b ON b.out_shard = d.out_shard
              AND b.upto > ({_HALF.format(24680)} * 2147483647 + {_HALF.format(13579)}) % d.every GROUP BY ALL),
filled AS (SELECT stream, sum(n)::BIGINT AS n
           FROM (SELECT stream, sum(whole) AS n FROM rests GROUP BY stream
                 UNION ALL SELECT stream, count(*) FROM hits GROUP BY stream) GROUP BY stream),
slot AS (SELECT stream, blocks, unnest(range(least(n, 2 * blocks))) AS slot FROM s JOIN filled USING (stream)),
drawn AS (SELECT stream, list_reduce(range(24), lambda x, r: CASE WHEN ({_BIT}) = 1 THEN {_OTHER} ELSE x END,
                                     slot % blocks) AS block FROM slot),
times AS (SELECT stream, block, count(*) AS times FROM drawn GROUP BY ALL),
piece AS (SELECT p.doc_id, s.stream, p.start, p.size,
                 unnest(range(p.start // 128, (p.start + p.size - 1) // 128 + 1)) AS block
          FROM placed p JOIN s ON s.source IS NOT DISTINCT FROM p.source WHERE p.size > 0),
taken AS (SELECT doc_id, sum((least(start + size, (block + 1) * 128) - greatest(start, block * 128)) * times) AS taken
          FROM piece JOIN times USING (stream, block) GROUP BY doc_id)
SELECT p.doc_id, p.size, s.source_size, s.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM placed p JOIN s ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN taken t ON t.doc_id = p.doc_id
"""
