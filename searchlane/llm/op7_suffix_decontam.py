"""Benchmark decontamination with suffix arrays over the training texts.

Each task turns a few megabytes of documents into a shard: benchmark words become
numbers (any other word ends a match), the suffixes that could hold a whole window are
sorted by their first ``window`` words, and every benchmark suffix is binary-searched in
that array, all suffixes at once. The interval it finds holds every occurrence; runs of
occurrences on one diagonal (document position less item position) give the longest
verbatim matches with their locations. Words are numbered by a dictionary of the words
themselves, so a match is exact.

The benchmark is searched in blocks of bounded size (``BLOCK_BYTES``, dealt by a hash of
the item); only such a block is sent to the tasks. Documents pass from block to block in
one stage and are never shuffled, so no passage, source or item can be too common.

Defined cases: null texts have no words; an item of fewer than ``window`` words, but not
none, is one window; repeated items count once; a null ``item_id`` is listed as ``null``;
an empty benchmark contaminates nothing; an empty table gives an empty result; other
columns travel in a struct, so that no name clashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlane.llm import textkit
from searchlane.llm.op3_substring_dedup import rest_of

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: lower-cases A-Z; every other byte that is no digit, letter or part of a non-ASCII character ends a word
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Block:
    """Bounded part of the benchmark: its vocabulary, windows and packed search keys."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names, starts, widths, owner, place, flat = [], [], [], [], [], []
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            width = min(window, len(words))
            for at in range(len(words) - width + 1):
                starts.append(len(flat) + at)
                widths.append(width)
                owner.append(len(self.names))
                place.append(at)
            flat += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            flat += [0] * window
            self.names.append(name)
        self.owner, self.place = np.array(owner, np.int64), np.array(place, np.int64)
        self.widths = np.array(widths, np.int64)
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.low = self.high = None
        if starts:
            at = np.array(starts)[:, None] + np.arange(window)
            grid = np.array(flat, np.int64)[at]
            inside = np.arange(window) < self.widths[:, None]
            self.low = self.pack(np.where(inside, grid, 0))
            self.high = self.pack(np.where(inside, grid, (1 << self.bits) - 1))

    def pack(self, grid: np.ndarray) -> list[np.ndarray]:
        """The columns of word numbers as few integers whose order is the words' order."""
        each, keys = max(1, 62 // self.bits), []
        for lo in range(0, grid.shape[1], each):
            key = np.zeros(len(grid), np.int64)
            for c in range(lo, min(lo + each, grid.shape[1])):
                key = (key << self.bits) | grid[:, c]
            keys.append(key)
        return keys


def _search(keys: list[np.ndarray], asked: list[np.ndarray], right: bool) -> np.ndarray:
    """First place in the sorted ``keys`` not below (``right``: above) each asked key."""
    lo = np.zeros(len(asked[0]), np.int64)
    hi = np.full(len(asked[0]), len(keys[0]), np.int64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        at = np.minimum(mid, len(keys[0]) - 1)
        below, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, a in zip(keys, asked):
            below |= same & (k[at] < a)
            same &= k[at] == a
        go = open_ & (below | same if right else below)
        lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
    return lo


def occurrences(x: np.ndarray, block: Block):
    """(position in ``x``, window number) of every occurrence, through the suffix array of ``x``."""
    if block.low is None or not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    stops = np.append(np.flatnonzero(x == 0), len(x))
    ahead = stops[np.searchsorted(stops, np.arange(len(x)))] - np.arange(len(x))
    sa = np.flatnonzero(ahead >= block.widths.min())
    if not len(sa):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    padded = np.concatenate((x, np.zeros(block.window, x.dtype)))
    reach = np.minimum(ahead[sa], block.window)
    grid = np.where(np.arange(block.window) < reach[:, None], padded[sa[:, None] + np.arange(block.window)], 0)
    keys = block.pack(grid)
    order = np.lexsort(keys[::-1])
    sa, keys = sa[order], [k[order] for k in keys]
    lo, hi = _search(keys, block.low, False), _search(keys, block.high, True)
    many = hi - lo
    asked = np.repeat(np.arange(len(many)), many)
    inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return sa[np.repeat(lo, many) + inner], asked


def scan(texts: list[bytes | None], block: Block):
    """Per text: number of words, [(at, n)] of the longest verbatim matches, names of the items found."""
    get, pieces, begins, at = block.vocabulary.get, [], [], 0
    counts = []
    for t in texts:
        words = words_of(t)
        counts.append(len(words))
        begins.append(at)
        pieces.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
        pieces.append(np.zeros(1, np.int64))
        at += len(words) + 1
    pos, asked = occurrences(np.concatenate(pieces), block)
    matches, found = [[] for _ in texts], [set() for _ in texts]
    if len(pos):
        own = block.owner[asked]
        diagonal = pos - block.place[asked]
        order = np.lexsort((pos, diagonal, own))
        pos, own, diagonal, width = pos[order], own[order], diagonal[order], block.widths[asked[order]]
        fresh = np.append(True, (np.diff(own) != 0) | (np.diff(diagonal) != 0) | (np.diff(pos) != 1))
        first = np.flatnonzero(fresh)
        length = np.diff(np.append(first, len(pos))) + width[first] - 1
        doc = np.searchsorted(begins, pos[first], side="right") - 1
        for d, p, n, o in zip(doc.tolist(), pos[first].tolist(), length.tolist(), own[first].tolist()):
            matches[d].append((p - begins[d], n))
            found[d].add(block.names[o])
    return counts, matches, found


def _scan_rows(items: list[tuple[str, bytes]], window: int):
    block = Block(items, window)

    def rows(batches):
        for batch in batches:
            for a, b in textkit.chunks(batch, "text"):
                part = batch.slice(a, b - a)
                counts, matches, found = scan(textkit.text_bytes(part.column("text")), block)
                had, names = part.column("matches").to_pylist(), part.column("items").to_pylist()
                out = {"n_words": pa.array(counts, pa.int64()),
                       "matches": pa.array([h + [{"at": p, "n": n} for p, n in sorted(set(m))]
                                            for h, m in zip(had, matches)], part.schema.field("matches").type),
                       "items": pa.array([h + sorted(f) for h, f in zip(names, found)],
                                         part.schema.field("items").type)}
                yield pa.RecordBatch.from_arrays([out.get(c, part.column(c)) for c in part.schema.names],
                                                 part.schema.names)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a row of ``docs``: doc_id, text, n_words, matches (at, n: longest verbatim
    matches), items (sorted names), n_hit, and the other columns in a struct ``rest``."""
    items = (benchmark.where("length(text) > 0")
             .select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "text")
             .distinct())
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    of_block = F.pmod(F.xxhash64("name", "text"), F.lit(blocks))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                      *rest_of(docs), F.lit(0).cast("long").alias("n_words"),
                      F.expr("cast(array() as array<struct<at:int,n:int>>)").alias("matches"),
                      F.expr("cast(array() as array<string>)").alias("items"))
    for b in range(blocks):
        held = [(r.name, r.text.encode()) for r in items.where(of_block == b).collect()]  # at most a block
        out = out.mapInArrow(_scan_rows(held, window), out.schema)
    covered = F.expr("""aggregate(array_sort(matches), struct(0 as n, 0 as upto),
        (s, m) -> struct(s.n + greatest(0, m.at + m.n - greatest(s.upto, m.at)) as n, greatest(s.upto, m.at + m.n) as upto),
        s -> cast(s.n as long))""")
    return out.withColumn("items", F.array_sort(F.array_distinct("items"))).withColumn("n_hit", covered)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window."""
    kept = contamination(docs, benchmark, window).where("n_hit = 0")
    others = [F.col("rest").getField(c).alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return kept.select("doc_id", "text", *others).select(*[f"`{c}`" for c in docs.columns])


def op7_suffix_decontam(spark, sf_dir):
    """Op 7 over the whole ``documents`` and ``benchmark`` tables."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"),
                          spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
