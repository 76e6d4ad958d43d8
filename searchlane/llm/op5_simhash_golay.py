"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint's 64 bits fall into five segments (13, 13, 13, 13 and 12 bits). Of at most
three differing bits, two segments hold none, and the segments can be paired so that a
third, the one midway between two clean ones, holds at most one. A segment value is the
start of a 23-bit word; the perfect Golay code has exactly one codeword within three
bits of any word, so the index of that codeword is a key that tolerates errors: a value
is filed under its own codeword and looked up under those of all values one bit away.
A key is (pair of clean segments, their bits, codeword index of the third). The join on
that key is verified by the bit distance, so it adds no false link, and by the
pigeonhole it misses none.

Documents with one fingerprint are one class before the join, whatever their number.
Links join distinct fingerprints; components come from distributed star contraction.

Defined cases: a null or empty text has the fingerprint zero and links like any other;
a null ``doc_id`` belongs to its component but names it only if every id there is null;
repeated rows give one row each; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlane.llm import scratch, textkit
from searchlane.llm.graph import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (first bit, bits)
GENERATOR = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1, generates the binary (23,12) Golay code


def _remainder(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit polynomials by the generator: the syndrome."""
    word = word.copy()
    for bit in range(22, 10, -1):
        word ^= np.where((word >> bit) & 1, GENERATOR << (bit - 11), 0)
    return word


def _corrections() -> np.ndarray:
    """Error pattern of at most three bits for each of the 2048 syndromes."""
    patterns = np.array([0] + [sum(1 << b for b in c) for k in (1, 2, 3) for c in combinations(range(23), k)])
    table = np.zeros(2048, np.int64)
    table[_remainder(patterns)] = patterns
    return table


def codeword_index(values: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    """Index (the 12 message bits) of the codeword nearest to each segment value, whose
    bits are the highest of the 23."""
    word = values.astype(np.int64) << (23 - bits)
    return (word ^ table[_remainder(word)]) >> 11


def key_tables() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment: the filing key of every value, and its look-up keys padded with -1."""
    table, out = _corrections(), []
    for _, bits in SEGMENTS:
        values = np.arange(1 << bits)
        own = codeword_index(values, bits, table)
        near = np.stack([own] + [own[values ^ (1 << b)] for b in range(bits)], axis=1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        out.append((own, near))
    return out


def segment_triples() -> list[tuple[int, int, int]]:
    """(clean, clean, at most one error): the third lies midway between the two, modulo five."""
    return [(i, j, 3 * (i + j) % 5) for i, j in combinations(range(5), 2)]


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends, at = [], -1
    for n in map(len, words):
        at += n + 1
        ends.append(at)
    begins = [0] + [e + 1 for e in ends]
    counts, total = np.zeros(64, np.int64), len(words) - shingle + 1
    for lo in range(0, total, 1 << 16):
        hi = min(total, lo + (1 << 16))
        h = b"".join([digest(joined[s:e], seed) for s, e in
                      zip(begins[lo:hi], ends[lo + shingle - 1:hi + shingle - 1])])
        counts += np.unpackbits(np.frombuffer(h, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _tie():
    """Tells rows without an id apart."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text"))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tie (a hash of the text where the id is null), fp (the fingerprint as a signed
    long), one row a row of ``docs``."""
    def rows(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t, shingle) for t in textkit.text_bytes(batch.column("text"))),
                             np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(fp.view(np.int64))],
                                             ["doc_id", "tie", "fp"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .withColumn("tie", _tie()).mapInArrow(rows, "doc_id long, tie long, fp long"))


def _keys(lookup: bool):
    def rows(batches):
        tables, triples = key_tables(), segment_triples()
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            seg = [(fp.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1) for at, bits in SEGMENTS]
            for t, (i, j, k) in enumerate(triples):
                clean = (np.int64(t) << 38) | (seg[i] << 25) | (seg[j] << 12)
                own, near = tables[k]
                if lookup:
                    found = near[seg[k]]
                    keep = found >= 0
                    key, of = (clean[:, None] | found)[keep], np.broadcast_to(fp[:, None], keep.shape)[keep]
                else:
                    key, of = clean | own[seg[k]], fp
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(of)], ["key", "b" if lookup else "a"])
    return rows


def near_links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints that differ in at most ``max_bits`` (up to three) bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the five-segment pigeonhole covers up to three differing bits")
    fps = classes.select("fp")
    filed = fps.mapInArrow(_keys(False), "key long, a long")
    asked = fps.mapInArrow(_keys(True), "key long, b long")
    # Spark sizes both sides by the table of classes, a tenth of the rows at most, and would broadcast them
    return (filed.hint("merge").join(asked, "key").where((F.col("a") < F.col("b")) &
                                           (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
            .select("a", "b").distinct())


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, tie, fp, component_id and root (the component's smallest fingerprint) for every row of ``docs``."""
    marked = scratch.store(fingerprints(docs, shingle), "simhash")
    classes = scratch.store(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash_classes")
    roots = components(near_links(classes, max_bits))
    of_class = (classes.join(roots, F.col("fp") == F.col("node"), "left")
                .select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    named = of_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = scratch.store(of_class.join(named, "root").select("fp", "root", "component_id"), "simhash_components")
    return marked.join(of_class, "fp").select("doc_id", "tie", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the smallest id, or the smallest hash
    of a text where no row has an id. Rows that share the kept id are one document."""
    groups = simhash_groups(docs, shingle, max_bits)
    first = groups.groupBy("root").agg(F.min("doc_id").alias("kept_id"),
                                       F.min(F.when(F.col("doc_id").isNull(), F.col("tie"))).alias("tie"))
    kept = first.select("kept_id", F.when(F.col("kept_id").isNull(), F.col("tie")).alias("kept_tie"))
    named = docs.withColumn("_kept_id", F.col("doc_id").cast("long")).withColumn("_kept_tie", _tie())
    return named.join(kept, F.col("_kept_id").eqNullSafe(F.col("kept_id"))
                      & F.col("_kept_tie").eqNullSafe(F.col("kept_tie")), "left_semi").select(*[f"`{c}`" for c in docs.columns])


def op5_simhash_golay(spark, sf_dir):
    """Op 5 over the whole ``documents`` table."""
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
