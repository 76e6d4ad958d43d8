"""Substring dedup by De Bruijn compaction.

Every run of ``window`` words is an edge of a De Bruijn graph whose nodes are the
runs one word shorter. The steps, all joins and aggregates keyed by hashes:

0. *Whole copies.* A text equal to that of a smaller document repeats in full; texts are
   grouped by a 128-bit digest and such copies leave the graph, all their windows gone.
1. *Anchors.* Windows that share their smallest ``anchor``-word hash form a run; one
   row a run (about a fifth of the words) is grouped by that hash. A window that
   repeats in another document has an anchor that repeats there too, so only runs
   with a repeated anchor go on. This is a prefilter and loses nothing.
2. *Edges.* The windows of those runs are keyed by a 64-bit hash, with 15 bits of the
   words before and after. In ``rounds`` slices of the key space (so that one slice's
   shuffle is on disk at a time) they are aggregated to the first document and joined
   to their coordinate there.
3. *Compaction.* An edge whose occurrences all have one successor, which in turn has
   one predecessor, continues the path. Joined back to the occurrences this turns
   consecutive windows of a document into spans, each with the source coordinate of
   its path.
4. *Verification.* The bytes at the source coordinate and the bytes of the span are
   digested apart (md5) and must agree before a word goes. Two windows with one 64-bit
   key can therefore never remove a word wrongly; the odds that they hide a repeat are
   about the number of repeated windows over 2^64.

Texts are written once, bucketed by row, and never shuffled again; hot passages are
one row a task after partial aggregation, and the joins back are plain equi-joins
whose large partitions adaptive execution can split.

Defined cases: null or empty text has no words, keeps nothing and removes nothing; a
null ``doc_id`` is larger than any other; rows that share a ``doc_id`` are one document
for the comparison (they never remove each other's windows) and one row each in the
result; an empty table gives an empty result; other columns travel in a struct, so
that no name clashes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from searchlane.llm import scratch, textkit

WINDOW = 13
ANCHOR = 6
ROUNDS = 3
_LAST = (1 << 63) - 1
_RESULT = [StructField("n_words", LongType()), StructField("n_removed", LongType()),
           StructField("kept_text", StringType())]


def _run_starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def _anchor_rows(window: int, anchor: int):
    reach = window - anchor + 1  # anchors inside one window

    def rows(batches):
        for batch in batches:
            for a, b in textkit.chunks(batch, "text"):
                part = batch.slice(a, b - a)
                hs, rids, docs, starts, lens = [], [], [], [], []
                for rid, doc, text in zip(part.column("rid").to_pylist(), part.column("doc").to_pylist(),
                                          textkit.text_bytes(part.column("text"))):
                    words = text.split() if text else []
                    n = len(words) - window + 1
                    if n <= 0:
                        continue
                    low = textkit.gram_hashes(textkit.word_hashes(words), anchor)
                    got = 1
                    while got < reach:  # smallest hash of each stretch, by doubling
                        step = min(got, reach - got)
                        low = np.minimum(low[:-step], low[step:])
                        got += step
                    at = _run_starts(low)
                    hs.append(low[at])
                    starts.append(at)
                    lens.append(np.diff(np.append(at, n)))
                    rids.append(np.full(len(at), rid, np.int64))
                    docs.append(np.full(len(at), doc, np.int64))
                if hs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(textkit.signed(np.concatenate(hs))), pa.array(np.concatenate(rids)),
                         pa.array(np.concatenate(docs)), pa.array(np.concatenate(starts).astype(np.int32)),
                         pa.array(np.concatenate(lens).astype(np.int32))],
                        ["h", "rid", "doc", "first", "n"])
    return rows


def _edge_rows(window: int):
    def rows(batches):
        for batch in batches:
            out = []
            for rid, doc, text, runs in zip(batch.column("rid").to_pylist(), batch.column("doc").to_pylist(),
                                            textkit.text_bytes(batch.column("text")), batch.column("runs").to_pylist()):
                w = textkit.word_hashes(text.split())
                keep = np.zeros(len(w) - window + 1, bool)
                for r in runs:
                    keep[r["first"]:r["first"] + r["n"]] = True
                pos = np.flatnonzero(keep)
                beside = np.concatenate(([0], (w & np.uint64(0x7FFF)).astype(np.int16) | 1, [0])).astype(np.int16)
                out.append((textkit.gram_hashes(w, window)[pos], np.full(len(pos), rid, np.int64),
                            np.full(len(pos), doc, np.int64), pos.astype(np.int32), beside[pos],
                            beside[pos + window + 1]))
            if out:
                key, *others = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (textkit.signed(key), *others)],
                                                 ["k", "rid", "doc", "pos", "prev", "next"])
    return rows


def _spans_of(words: list[bytes], spans: list[dict]) -> list[bytes]:
    return [hashlib.md5(b" ".join(words[s["at"]:s["at"] + s["n"]])).digest() for s in spans]


def _source_digests(batches):
    for batch in batches:
        rid, at, n, digest = [], [], [], []
        for r, text, spans in zip(batch.column("rid").to_pylist(), textkit.text_bytes(batch.column("text")),
                                  batch.column("spans").to_pylist()):
            rid += [r] * len(spans)
            at += [s["at"] for s in spans]
            n += [s["n"] for s in spans]
            digest += _spans_of(text.split(), spans)
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()),
                                          pa.array(digest, pa.binary())], ["src_rid", "src_at", "n", "digest"])


def _cut(layout: bool, carried: list[str], window: int):
    def rows(batches):
        for batch in batches:
            yield from _cut_batch(batch, layout, carried, window)
    return rows


def _cut_batch(batch, layout: bool, carried: list[str], window: int):
    for a, b in textkit.chunks(batch, "text"):
        part = batch.slice(a, b - a)
        n_words, n_removed, kept = [], [], []
        for text, spans, copy in zip(textkit.text_bytes(part.column("text")), part.column("spans").to_pylist(),
                                     part.column("copy").to_pylist()):
            words = text.split() if text else []
            stay = np.ones(len(words), bool)
            if copy and len(words) >= window:
                stay[:] = False
            if spans:
                for s, own in zip(spans, _spans_of(words, spans)):
                    if own == s["digest"]:
                        stay[s["at"]:s["at"] + s["n"]] = False
            n_words.append(len(words))
            n_removed.append(int(len(words) - stay.sum()))
            if n_removed[-1]:
                words = [w for w, k in zip(words, stay.tolist()) if k]
            kept.append(text if layout and not n_removed[-1] else b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [part.column(c) for c in carried] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                                 pa.array(kept, pa.binary()).cast(pa.string())],
            [*carried, "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, layout: bool = False,
                    rounds: int = ROUNDS) -> DataFrame:
    """One row a row of ``docs``: doc_id, n_words, n_removed, kept_text (kept words joined
    by one space), and the other columns in a struct ``rest``. With ``layout`` a text
    that loses no word keeps its own white space."""
    spark = docs.sparkSession
    # buckets: an input split each, but not fewer than a shuffle has, or Spark deals the texts anew
    parts = max(scratch.input_partitions(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       *rest_of(docs))
    texts = scratch.store_bucketed(
        base.withColumn("rid", F.monotonically_increasing_id())
        .withColumn("doc", F.coalesce("doc_id", F.lit(_LAST))), "rid", parts, "dedup_texts")
    scratch.free_shuffles(spark)

    copies = _whole_copies(texts)
    with_text = (texts.where("length(text) > 0").select("rid", "doc", "text")
                 .join(copies.hint("shuffle_hash"), "rid", "left_anti"))
    runs = with_text.mapInArrow(_anchor_rows(window, anchor), "h long, rid long, doc long, first int, n int")
    again = scratch.store(runs.groupBy("h").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
                          .where("lo < hi").select("h"), "dedup_anchors")
    scratch.free_shuffles(spark)
    found = scratch.store(
        runs.drop("doc").join(again.hint("shuffle_hash"), "h")
        .groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("runs")), "dedup_runs")
    scratch.free_shuffles(spark)
    edges = scratch.store(
        texts.select("rid", "doc", "text").join(found.hint("shuffle_hash"), "rid").select("rid", "doc", "text", "runs")
        .mapInArrow(_edge_rows(window), "k long, rid long, doc long, pos int, prev short, next short"), "dedup_edges")
    scratch.discard(found)
    scratch.discard(again)
    scratch.free_shuffles(spark)
    slices = []
    for r in range(rounds):
        slices.append(scratch.store(_hits(edges.where(F.pmod("k", F.lit(rounds)) == r)), "dedup_hits"))
        scratch.free_shuffles(spark)
    scratch.discard(edges)
    hits = reduce(DataFrame.unionAll, slices)
    along = Window.partitionBy("rid").orderBy("pos")
    begins = F.when((F.lag("pos").over(along) == F.col("pos") - 1) & F.lag("one_out").over(along) & F.col("one_in")
                    & (F.lag("src_rid").over(along) == F.col("src_rid"))
                    & (F.lag("src_at").over(along) == F.col("src_at") - 1), 0).otherwise(1)
    spans = (hits.withColumn("begins", begins)
             .withColumn("path", F.sum("begins").over(along.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("rid", "path")
             .agg(F.min("pos").alias("at"), (F.count(F.lit(1)) + (window - 1)).cast("int").alias("n"),
                  F.min(F.when(F.col("begins") == 1, F.col("src_rid"))).alias("src_rid"),
                  F.min(F.when(F.col("begins") == 1, F.col("src_at"))).alias("src_at"))
             .drop("path"))
    spans = scratch.store(spans, "dedup_spans")
    for x in slices:
        scratch.discard(x)
    scratch.free_shuffles(spark)

    asked = (spans.select("src_rid", "src_at", "n").distinct()
             .groupBy(F.col("src_rid").alias("rid"))
             .agg(F.collect_list(F.struct(F.col("src_at").alias("at"), "n")).alias("spans")))
    source = (with_text.select("rid", "text").join(asked.hint("shuffle_hash"), "rid")
              .mapInArrow(_source_digests, "src_rid long, src_at int, n int, digest binary"))
    # the spans' file holds a few bytes a row: by its size Spark would broadcast millions of rows
    checked = (spans.hint("merge").join(source, ["src_rid", "src_at", "n"])
               .groupBy("rid").agg(F.collect_list(F.struct("at", "n", "digest")).alias("spans")))
    carried = base.drop("text").columns
    kinds = base.drop("text").schema
    done = (texts.drop("doc").join(checked.hint("shuffle_hash"), "rid", "left")
            .join(copies.withColumn("copy", F.lit(True)).hint("shuffle_hash"), "rid", "left")
            .select(*carried, "text", "spans", "copy"))
    schema = StructType([*kinds.fields, *_RESULT])
    return done.mapInArrow(_cut(layout, carried, window), schema)


def _whole_copies(texts: DataFrame) -> DataFrame:
    """rid of the rows whose text is that of a document with a smaller id."""
    digests = scratch.store(texts.where("length(text) > 0").select("rid", "doc", F.unhex(F.md5("text")).alias("digest")),
                            "dedup_digests")
    first = scratch.store(digests.groupBy("digest").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
                          .where("lo < hi"), "dedup_copied")  # a table, so that the join can split a hot digest
    return scratch.store(digests.join(first, "digest").where("lo < doc").select("rid"), "dedup_copies")


def _hits(edges: DataFrame) -> DataFrame:
    """Windows that start in a smaller document too, with a coordinate there."""
    first = scratch.store(
        edges.groupBy("k")
        .agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"),
             F.min_by("rid", "doc").alias("src_rid"), F.min_by("pos", "doc").alias("src_at"),
             (F.min("prev") == F.max("prev")).alias("one_in"), (F.min("next") == F.max("next")).alias("one_out"))
        .where("lo < hi").drop("hi"), "dedup_first")
    # the aggregate is a table of its own: adaptive execution splits a hot key's partition
    # only where both sides of the join come straight from a shuffle
    return (edges.select("k", "rid", "doc", "pos").join(first.hint("shuffle_hash"), "k").where("lo < doc")
            .select("rid", "pos", "src_rid", "src_at", "one_in", "one_out"))


def rest_of(docs: DataFrame) -> list:
    """The columns beside doc_id and text, as one struct that no name can clash with."""
    others = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")]
    return [F.struct(*others).alias("rest")] if others else []


def op3_substring_dedup(spark, sf_dir):
    """Op 3 over the whole ``documents`` table."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
