"""Importance resampling of a corpus towards a target text collection.

Every text becomes a bag of hashed word n-grams. Bucket counts of the corpus and of the
target give an array with one log-ratio gain a bucket; a document's weight is the sum of
its features' gains, read from that array in numpy, and a seeded Gumbel term by document
turns the k highest scores into a draw without replacement.

The draw is a distributed quickselect. Candidates carry a composite key (score, doc_id,
features, place) that no two rows share. Each round draws random pivot keys from the
candidates left, counts exactly how many candidates lie between and at the pivots, and
keeps the part that holds the k-th key, until a pivot is that key. Only its winners are
range-sorted and ranked; all other rows are passed through without a sort or a join.

CRC-32 is linear, so the bucket of a run of words follows from the words' own checksums
and lengths by table look-ups: no run of words is ever put together. Texts are read in
pieces of ``PIECE`` bytes, cut between words, so one very long text needs no more memory
than many short ones. The driver holds one number a bucket and the pivots of a round.

Defined cases: null texts have no features (weight 0); a null ``doc_id`` seeds its term as
an empty id, and comes after all ids in a tie; repeated rows take part one by one; of rows
with equal score and id the one with fewer features goes first; an empty target or an
empty table gives a result all the same (no rows, for an empty table); other columns are
left alone and travel in ``rest`` of :func:`draw`.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlane.llm import scratch, textkit
from searchlane.operators.batching import with_row_index

BUCKETS = 10_000
LONGEST = 3
SEED = 42
LEAST_WORDS = 20
PERCENT = 5
#: bytes of text that one numpy pass holds
PIECE = 1 << 20
#: random pivots a round; a round narrows the candidates by about this factor
PIVOTS = 16
#: lower-cases A-Z; digits, letters and bytes of non-ASCII characters make words
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SPACE = np.uint32(zlib.crc32(b" "))


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given by its four tables of 256 entries."""
    return (table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24])


class Shifts:
    """Checksum of a text followed by n bytes, less the checksum of those bytes."""

    def __init__(self, direct: int = 64, doublings: int = 26):
        byte = np.arange(256, dtype=np.uint32)
        ends = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
        one = np.stack([ends, byte, byte << np.uint32(8), byte << np.uint32(16)])  # one zero byte
        self.direct = np.empty((direct, 4, 256), np.uint32)
        self.direct[0] = np.stack([byte << np.uint32(8 * k) for k in range(4)])
        for n in range(1, direct):
            self.direct[n] = _apply(one, self.direct[n - 1])
        self.doubled = [_apply(one, self.direct[direct - 1])]
        for _ in range(doublings):
            self.doubled.append(_apply(self.doubled[-1], self.doubled[-1]))

    def __call__(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        size = len(self.direct)
        low = n % size
        out = (self.direct[low, 0, x & 255] ^ self.direct[low, 1, (x >> 8) & 255]
               ^ self.direct[low, 2, (x >> 16) & 255] ^ self.direct[low, 3, x >> 24])
        high, bit = n // size, 0
        while high.any():
            odd = (high & 1).astype(bool)
            out[odd] = _apply(self.doubled[bit], out[odd])
            high, bit = high >> 1, bit + 1
        return out


def run_checksums(crc: np.ndarray, size: np.ndarray, longest: int, shifts: Shifts) -> list[np.ndarray]:
    """For m = 1 .. ``longest``: the checksum of every run of m words, joined by a space."""
    after_space, out = shifts(np.full(len(crc), SPACE), size) ^ crc, [crc]
    for m in range(2, longest + 1):
        if len(crc) < m:
            break
        out.append(shifts(out[-1][:len(crc) - m + 1], size[m - 1:] + 1) ^ after_space[m - 1:])
    return out


def _pieces(texts: list[bytes | None], piece: int):
    """(row, words, True if the words go on from the piece before) of bounded bytes."""
    for row, text in enumerate(texts):
        if not text:
            continue
        lo, more = 0, False
        while lo < len(text):
            hi = len(text)
            if hi - lo > piece:  # cut where a word ends; a word longer than that stays whole
                hi = lo + piece
                while hi < len(text) and FOLD[text[hi]] != 32:
                    hi += 1
            words = text[lo:hi].translate(FOLD).split()
            if words:
                yield row, words, more
                more = True
            lo = hi


def features(texts: list[bytes | None], buckets: int, longest: int, shifts: Shifts, piece: int = PIECE):
    """(row, bucket) arrays of all runs of 1 to ``longest`` words, in bounded chunks. A run
    is reported once, with the words it ends in, also where pieces of one text meet."""
    def chunk(held):
        crcs, sizes, rows, new = [], [], [], []
        for row, crc, size, carried in held:
            crcs.append(crc), sizes.append(size), rows.append(np.full(len(crc), row))
            new.append(np.arange(len(crc)) >= carried)
        rows, new = np.concatenate(rows), np.concatenate(new)
        for m, sums in enumerate(run_checksums(np.concatenate(crcs), np.concatenate(sizes), longest, shifts), 1):
            ends = rows[m - 1:]
            keep = new[m - 1:] & (ends == rows[:len(rows) - m + 1])
            yield ends[keep], (sums[keep] % np.uint32(buckets)).astype(np.int64), m

    held, words_held, last = [], 0, None
    for row, words, more in _pieces(texts, piece):
        crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        carried = 0
        if more:  # the words before, for the runs that reach back; they are no ends
            old_crc, old_size = last
            crc, size = np.concatenate((old_crc, crc)), np.concatenate((old_size, size))
            carried = len(old_crc)
            if held:  # rows must not touch across the repeated words
                yield from chunk(held)
                held, words_held = [], 0
        back = max(0, len(crc) - (longest - 1))
        last = crc[back:], size[back:]
        held.append((row, crc, size, carried))
        words_held += len(words)
        if words_held * 6 > piece:
            yield from chunk(held)
            held, words_held = [], 0
    if held:
        yield from chunk(held)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): how often features fall into each bucket, counted by task in one array."""
    def rows(batches):
        shifts, counts = Shifts(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, at, _ in features(textkit.text_bytes(batch.column(0)), buckets, longest, shifts):
                counts += np.bincount(at, minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["bucket", "n"])

    return (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(rows, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) for each bucket."""
    counts = []
    for table in (target, docs):
        held = np.zeros(buckets, np.int64)
        for r in bucket_counts(table, buckets, longest).collect():  # at most one row a bucket
            held[r.bucket] = r.n
        counts.append(held)
    t, s = counts
    above, below = float(int(s.sum()) + buckets), float(int(t.sum()) + buckets)
    return np.array([math.floor(1000 * math.log((float(a) + 1) * above / ((float(b) + 1) * below)))
                     for a, b in zip(t.tolist(), s.tolist())], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST, rest: bool = False) -> DataFrame:
    """doc_id, n_words, n_features, weight and ``rest`` (all columns if asked for, else null) of every row."""
    buckets = len(gains)

    def rows(batches):
        shifts = Shifts()
        for batch in batches:
            n = batch.num_rows
            words, found, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for row, at, m in features(textkit.text_bytes(batch.column("text")), buckets, longest, shifts):
                each = np.bincount(row, minlength=n)
                found += each
                words += each if m == 1 else 0
                weight += np.bincount(row, gains[at], n).astype(np.int64)  # sums of integers below 2^53: exact
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array(found), pa.array(weight), batch.column("rest")],
                ["doc_id", "n_words", "n_features", "weight", "rest"])

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.struct(*[f"`{c}`" for c in docs.columns]).alias("rest") if rest
                        else F.lit(None).cast("struct<none:int>").alias("rest"))
    return frame.mapInArrow(rows, frame.select(
        "doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_words", "n_features", "weight")], "rest").schema)


def gumbel(doc_id: str, seed: int) -> Column:
    """Seeded Gumbel noise by document, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256),
                           1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _key() -> Column:
    """Ascending order of this struct is the order of the draw."""
    return F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("z"),
                    F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("n_features").alias("n"), F.col("place").alias("p"))


def _literal(key) -> Column:
    return F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in
                      zip(key, ("long", "boolean", "long", "long", "long"), "szdnp")])


def kth_key(candidates: DataFrame, k: int, seed: int = SEED, pivots: int = PIVOTS):
    """The k-th smallest (from 1) composite key of ``candidates`` (score, doc_id, n_features,
    place) by quickselect, as a tuple. Each round counts, exactly and in one aggregate of
    2 x ``pivots`` + 1 rows, the candidates below, at and above every random pivot, and
    writes the part between two pivots that holds the k-th as the next round's table."""
    keyed = candidates.select(_key().alias("key"))
    left, turn, held = k, 0, None
    while True:
        picked = sorted(tuple(r.key) for r in keyed.orderBy(F.xxhash64("key.p", F.lit(seed + turn)), "key.p")
                        .limit(pivots).collect())
        if not picked:
            raise ValueError(f"no {k}-th key: fewer candidates")
        slot = sum(((F.col("key") >= _literal(p)).cast("int") + (F.col("key") > _literal(p)).cast("int")
                    for p in picked), F.lit(0))
        parts = {r.slot: r["count"] for r in keyed.groupBy(slot.alias("slot")).count().collect()}
        for at in range(2 * len(picked) + 1):  # even: between pivots; odd: a pivot itself
            n = parts.get(at, 0)
            if left <= n:
                break
            left -= n
        else:
            raise ValueError(f"no {k}-th key: fewer candidates")
        if at % 2:
            if held is not None:
                scratch.discard(held)
            return picked[at // 2]
        inner = keyed
        if at:
            inner = inner.where(F.col("key") > _literal(picked[at // 2 - 1]))
        if at < 2 * len(picked):
            inner = inner.where(F.col("key") < _literal(picked[at // 2]))
        now = scratch.store(inner, "resampling_candidates")
        if held is not None:
            scratch.discard(held)
        keyed, held, turn = now, now, turn + 1


def ranked(scored: DataFrame, share_percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``scored`` (a written table with place) with the ``rank`` of drawn rows: floor(share x
    rows of at least ``least_words`` words) of them."""
    able = scored.where(F.col("n_words") >= least_words)
    k = able.count() * share_percent // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    last = kth_key(able, k, seed)
    wins = (F.col("n_words") >= least_words) & (_key() <= _literal(last))
    winners = with_row_index(scored.where(wins), [_key()], "rank")
    return (winners.withColumn("rank", F.col("rank") + 1)
            .unionByName(scored.where(~wins).withColumn("rank", F.lit(None).cast("long"))))


def scores(docs: DataFrame, target: DataFrame, seed: int = SEED, rest: bool = False) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, place (a number of its own for each row) and
    rest, as a written table."""
    gains = bucket_gains(docs, target)
    return scratch.store(weighted(docs, gains, rest=rest).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
                         .withColumn("place", F.monotonically_increasing_id()), "resampling_scores")


def resample(docs: DataFrame, target: DataFrame, share_percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED) -> DataFrame:
    """Every row's doc_id, n_words, n_features, weight, score, rank (null: not drawn)."""
    return ranked(scores(docs, target, seed).drop("rest"), share_percent, least_words, seed).drop("place")


def draw(docs: DataFrame, target: DataFrame, share_percent: int = PERCENT, least_words: int = LEAST_WORDS,
         seed: int = SEED) -> DataFrame:
    """The drawn rows alone: rank, weight, score and all columns of ``docs`` in ``rest``."""
    out = ranked(scores(docs, target, seed, rest=True), share_percent, least_words, seed)
    return out.where(F.col("rank").isNotNull()).select("rank", "weight", "score", "rest")


def op11_importance_resampling(spark, sf_dir):
    """Op 11 over the whole ``documents`` and ``benchmark`` tables."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
