"""Near duplicates by MinHash bands, verified through odd sketches.

A document is the set of its distinct word shingles. One numpy pass takes ``BANDS`` x
``ROWS`` MinHash samples of each set; the samples of a band make its bucket key, and all
samples together are folded into an odd sketch: a bitmap in which every (sample number,
sample) flips one bit. The population count of two sketches' XOR estimates how many samples
differ, hence the similarity, the more precisely the higher it is. A pair that shares a
bucket is dropped by the sketch only if it looks ``SIGMAS`` deviations less alike than the
threshold asks; every other pair is confirmed on the full sets. Equal sets are one class
before the bands, whatever their number.

Links only serve the components, so a bucket is not expanded into its pairs. First every
class of a bucket is held against one head, the class that shares most buckets with others;
this joins up most of a group of copies. Where some class of a head's group stays apart,
two classes of the group can only be linked yet if their differences from the head agree in
so many shingles (:func:`_apart`); an exact prefix filter on the rarest differences finds
the pairs that could, and these are compared. No link that could join two components is
left out, and no bucket is capped.

Two sets of similarity s share a bucket with odds 1 - (1 - s^ROWS)^BANDS: for s = 0.8 all
but 1 in 10 million pairs do. The sketch drops a true pair at 6 deviations, about 1 in a
billion. Shingles are 64-bit hashes and classes have 128-bit digests; sets of a million
shingles meet a false equality with odds of about 1 in 10 million a pair.

Defined cases: with fewer words than a shingle, the whole sequence is the one shingle;
without words, or with a null text, a set is empty and linked with nothing; a null
``doc_id`` belongs to its component but names it only if every id there is null; repeated
rows give one row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlane.llm import scratch, textkit
from searchlane.llm.graph import components
from searchlane.operators.common import bounded_broadcast

SHINGLE = 2
THRESHOLD_PERCENT = 80
BANDS = 54
ROWS = 6
SKETCH_BITS = 1024
SIGMAS = 6.0
SEED = 20_13
#: shingles that one pass of the sampling holds against all hash functions
SLICE = 128
#: set members that may meet one representative in a task
PER_SALT = 512
#: rows (24 bytes each) of a table of wanted texts that may be broadcast
WANTED_ROWS = 1_000_000


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(textkit.gram_hashes(textkit.word_hashes(words), min(shingle, len(words))))


class Sampler:
    """``bands`` x ``rows`` MinHash samples of a set, the band keys and the odd sketch."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        n = bands * rows
        self.shape, self.bits = (bands, rows), bits
        self.factor = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offset = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.number = textkit.mix(np.arange(1, n + 1, dtype=np.uint64))
        self.band = textkit.mix(np.arange(n + 1, n + bands + 1, dtype=np.uint64))

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        """The smallest value of each hash function over the set."""
        low = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), SLICE):
            part = hashes[at:at + SLICE]
            low = np.minimum(low, (part[:, None] * self.factor + self.offset).min(axis=0))
        return low

    def keys(self, samples: np.ndarray) -> np.ndarray:
        grid, key = textkit.mix(samples).reshape(self.shape), self.band.copy()
        for c in range(self.shape[1]):
            key = textkit.mix(key + grid[:, c])
        return key

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        """Parity bitmap in 64-bit words: each sample flips the bit its hash names."""
        bit = textkit.mix(samples ^ self.number) % np.uint64(self.bits)
        parity = np.bincount(bit.astype(np.int64), minlength=self.bits).astype(np.uint8) & 1
        return np.packbits(parity).view(np.uint64)


def sketch_similarity(differing: Column, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> Column:
    """Similarity estimated from the XOR's population count: 1 + bits/(4 samples) ln(1 - 2 count/bits)."""
    left = F.greatest(F.lit(1.0) - differing * (2.0 / bits), F.lit(1e-9))
    return F.lit(1.0) + F.log(left) * (bits / (4.0 * samples))


def sketch_floor(percent: int = THRESHOLD_PERCENT, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS,
                 sigmas: float = SIGMAS) -> float:
    """Least estimate to accept. The spread has two parts: samples that agree by chance, and
    bits that several differing samples share."""
    s = percent / 100
    load = 2 * samples * (1 - s) / bits  # flips by bit
    shared = bits * (1 - math.exp(-4 * load)) / 4 - bits * load * math.exp(-4 * load)
    slope = bits / (4 * samples) * (2 / bits) / math.exp(-2 * load)
    return s - sigmas * math.sqrt(s * (1 - s) / samples + max(shared, 0.0) * slope ** 2)


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
               bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, t (hash of the text), n (set size), d1, d2 (digest of the set), keys, sketch, a row
    for each row of ``docs``; empty sets have no keys and no sketch."""
    def sign(batches):
        sampler = Sampler(bands, rows, bits)
        for batch in batches:
            for lo, hi in textkit.chunks(batch, "text"):
                part = batch.slice(lo, hi - lo)
                n, digest, keys, sketch = [], [], [], []
                for text in textkit.text_bytes(part.column("text")):
                    h = shingle_hashes(text, shingle)
                    n.append(len(h))
                    digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                    if len(h):
                        low = sampler.samples(h)
                        keys.append(textkit.signed(sampler.keys(low)))
                        sketch.append(textkit.signed(sampler.sketch(low)))
                    else:
                        keys.append(None), sketch.append(None)
                both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("t"), pa.array(n, pa.int64()), pa.array(both[:, 0]),
                     pa.array(both[:, 1]), pa.array(keys, longs), pa.array(sketch, longs)],
                    ["doc_id", "t", "n", "d1", "d2", "keys", "sketch"])

    return _slim(docs).mapInArrow(sign, "doc_id long, t long, n long, d1 long, d2 long, keys array<long>, sketch array<long>")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64(F.col("text").cast("string")).alias("t"))


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(c, shingles) for the classes of ``wanted`` (c, first_id, t, d1, d2), from their texts. A row
    counts as a class's text by the digest of its set, so a shared id or hash is harmless."""
    def rows(batches):
        for batch in batches:
            seen = set()
            for lo, hi in textkit.chunks(batch, "text"):
                part = batch.slice(lo, hi - lo)
                c, sets = [], []
                for text, a, b, k in zip(textkit.text_bytes(part.column("text")), *(
                        part.column(x).to_pylist() for x in ("d1", "d2", "c"))):
                    if k in seen:
                        continue
                    h = shingle_hashes(text, shingle)
                    if np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64).tolist() == [a, b]:
                        seen.add(k), c.append(k), sets.append(textkit.signed(h))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                                 ["c", "shingles"])

    asked = bounded_broadcast(wanted.select("c", F.col("first_id").alias("w_id"), F.col("t").alias("w_t"), "d1", "d2"),
                              WANTED_ROWS)
    found = _slim(docs).join(asked, (F.col("t") == F.col("w_t")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    return (found.select("c", "d1", "d2", "text").mapInArrow(rows, "c long, shingles array<long>")
            .dropDuplicates(["c"]))


def _salted(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (a, b) dealt over salts of ``PER_SALT`` pairs of one class a, and the salts of each a.
    Only classes of more pairs get several; they are few, and broadcast within a bound, so
    that the pairs stay where they are."""
    hot = bounded_broadcast(scratch.store(
        pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_SALT).cast("int").alias("salts")).where("salts > 1"),
        "odd_hot"), WANTED_ROWS)
    salts = F.coalesce("salts", F.lit(1))
    dealt = (pairs.join(hot, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int")).drop("salts"))
    each = pairs.select("a").distinct().join(hot, "a", "left")
    return dealt, each.select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))


def _with_sides(dealt: DataFrame, salts: DataFrame, side: DataFrame) -> DataFrame:
    """Dealt pairs with the columns of ``side`` (c, ...) of both classes, as x_a and x_b. A class a
    is copied once a salt, so no task holds all pairs of one."""
    a, b = ([f"{x}_{end}" if x != "c" else end for x in side.columns] for end in "ab")
    return dealt.join(side.toDF(*b), "b").join(side.toDF(*a).join(salts, "a"), ["a", "salt"])


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a written table whose sets are alike enough: by size, by sketch, by
    the full sets."""
    dealt, salts = _salted(pairs)
    differing = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                            F.lit(0), lambda s, x: s + x)
    near = scratch.store(
        _with_sides(dealt, salts, classes.select("c", "n", "sketch"))
        .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        .where(sketch_similarity(differing) >= sketch_floor(percent)).select("a", "b", "salt", "n_a", "n_b"), "odd_near")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return (_with_sides(near, salts, sets).withColumn("shared", shared)
            .where(F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * percent)
            .select("a", "b"))


def _apart(star: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes held against one head that lie in different components and may
    be linked; all that are linked are among them.

    Let D be the shingles of the head, h in number, that a class lacks, A those it adds, and
    W = percent |A| + 100 |D|. Two classes i, j are linked if and only if the o differences
    they share reach (100 + percent) o >= W_i + W_j - (100 - percent) h. One of them, say i, is
    not linked with the head: W_i > (100 - percent) h. So o > W_j / (100 + percent), and as
    W_j >= percent o, also 100 o >= W_i - (100 - percent) h. Two lists of which o entries agree
    share one among the first (length - o + 1) of each in any common order; here the rarest
    come first."""
    named = (star.join(roots.toDF("b", "root_b"), "b", "left").join(roots.toDF("a", "root_a"), "a", "left")
             .select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root")))
    open_ = named.where("root_a <> root").select("a").distinct()
    named = scratch.store(named.join(open_, "a", "left_semi").drop("root_a"), "odd_open")
    dealt, salts = _salted(named)
    lacks, adds = F.array_except("shingles_a", "shingles_b"), F.array_except("shingles_b", "shingles_a")
    weight = F.size("adds") * percent + F.size("lacks") * 100
    slack = F.size("shingles_a") * (100 - percent)
    need = F.when(F.col("weight") > F.col("slack"), F.ceil((F.col("weight") - F.col("slack")) / 100)).otherwise(
        F.floor(F.col("weight") / (100 + percent)) + 1)
    held = scratch.store(
        _with_sides(dealt, salts, sets).withColumn("lacks", lacks).withColumn("adds", adds)
        .withColumn("weight", weight).withColumn("slack", slack)
        .select(F.col("a").alias("head"), F.col("b").alias("c"), "root", "weight", "slack",
                F.concat("lacks", "adds").alias("marks"), (F.size("lacks") + F.size("adds") - need + 1).alias("first")),
        "odd_differences")
    marks = held.select("head", "c", "first", F.explode("marks").alias("mark"))
    seen = marks.groupBy("head", "mark").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    order = Window.partitionBy("head", "c").orderBy(F.coalesce("seen", F.lit(1)), "mark")
    early = (marks.join(seen, ["head", "mark"], "left").withColumn("at", F.row_number().over(order))
             .where((F.col("at") <= F.col("first")) & F.col("seen").isNotNull()).select("head", "c", "mark", "at"))
    early = scratch.store(early.join(held.select("head", "c", "root", "weight", "slack", F.size("marks").alias("size")),
                                     ["head", "c"]), "odd_prefixes")
    x, y = (early.select("head", "mark", *[F.col(k).alias(f"{k}_{end}") for k in ("c", "at", "root", "weight", "size")],
                         "slack" if end == "a" else F.lit(0).alias("none")) for end in "ab")
    overlap = F.ceil((F.col("weight_a") + F.col("weight_b") - F.col("slack")) / (100 + percent))
    return (x.join(y, ["head", "mark"])
            .where((F.col("c_a") < F.col("c_b")) & (F.col("root_a") != F.col("root_b"))
                   & (F.col("at_a") <= F.col("size_a") - overlap + 1) & (F.col("at_b") <= F.col("size_b") - overlap + 1))
            .select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct())


def near_links(docs: DataFrame, classes: DataFrame, percent: int = THRESHOLD_PERCENT,
               shingle: int = SHINGLE) -> DataFrame:
    """Links (a, b) between classes that join up all components; see the module's text."""
    buckets = classes.where("n > 0").select("c", F.explode("keys").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = scratch.store(buckets.join(sizes, "key"), "odd_buckets")
    meets = members.groupBy("c").agg(F.sum("size").alias("meets"))
    heads = (members.join(meets, "c").groupBy("key")
             .agg(F.max(F.struct("meets", F.col("c").alias("head"))).alias("m")).select("key", "m.head"))
    wanted = classes.join(meets, "c", "left_semi")
    sets = scratch.store(full_sets(docs, wanted, shingle), "odd_sets")
    star = scratch.store(members.join(heads, "key").where("c <> head")
                         .select(F.col("head").alias("a"), F.col("c").alias("b")).distinct(), "odd_star")
    first = scratch.store(_verified(star, classes, sets, percent), "odd_links")
    roots = scratch.store(components(first).toDF("c", "r"), "odd_roots")
    apart = scratch.store(_apart(star, roots, sets, percent), "odd_apart")
    return first.unionByName(scratch.store(_verified(apart, classes, sets, percent), "odd_links"))


def near_groups(docs: DataFrame, percent: int = THRESHOLD_PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the row's id names its component) for every row."""
    marked = scratch.store(signatures(docs, shingle), "odd_signatures")
    classes = scratch.store(
        marked.where("n > 0").groupBy("d1", "d2")
        .agg(F.min_by(F.struct("t", "n", "keys", "sketch"), F.struct(F.col("doc_id").isNull(), "doc_id", "t")).alias("x"),
             F.min("doc_id").alias("first_id"))
        .select("d1", "d2", "first_id", "x.*").withColumn("c", F.monotonically_increasing_id()), "odd_classes")
    roots = components(near_links(docs, classes, percent, shingle)).toDF("c", "r")
    rooted = classes.select("c", "d1", "d2", "first_id").join(roots, "c", "left").withColumn("root", F.coalesce("r", "c"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = scratch.store(rooted.join(named, "root").select("d1", "d2", "component_id"), "odd_components")
    joined = marked.where("n > 0").select("doc_id", "n", "d1", "d2").join(of_class, ["d1", "d2"])
    alone = marked.where("n = 0").select("doc_id", "n", "d1", "d2", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op13_odd_sketches(spark, sf_dir):
    """Op 13 over the whole ``documents`` table."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
