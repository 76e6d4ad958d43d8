"""Audit of how far sources of one language differ in the terms they use.

Each (lang, source) group and each language gives every kept term (one that at least
``LEAST_DOCS`` documents of the language hold) a probability p in billionths from its
smoothed count. p depends on the term only through its count, so how a pair of groups
differ is a sum over pairs of count levels. For a block of terms, X has one indicator
column for each (group, count level) and one row a term; the blocked products of X's
transpose with X hold, exactly, how many terms have level a in one group and b in another:
the joint table of every pair of groups at once. Each joint table is priced with integer
f = floor((p - q)^2 / q) a cell, so a price is computed once for all terms that share both
levels, and blocks add up. Terms are sorted by their counts before they are cut into
blocks, so that rare terms, which are most, need few columns.

Counts are taken where the texts lie, in one dictionary a task of at most ``HELD`` entries.
Terms are dealt by a hash, whatever their language; the (small) rows of the groups go to
every part as rows of the same sort, so nothing is broadcast or collected. A term's row has
one entry a source that uses it; groups are taken ``GROUPS`` at a time on either side of a
product.

All numbers are integers: Python's or decimal where they could pass 2^63, 64-bit ones
else; the products count at most ``TERMS`` terms a cell, exact in single precision.

Defined cases: null text, lang and source are ''; a group without terms counts 0 of each
term; a language without kept terms has value 0 for every pair of its groups; repeated
rows count as documents of their own; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlane.llm import scratch, textkit

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: (lang, source, term) entries a task counts before it passes them on
HELD = 300_000
#: terms of one part, of one block, and columns of one block that end it
PART_TERMS, TERMS, COLUMNS = 65_536, 4096, 1024
#: groups on either side of a product
GROUPS = 32
#: lower-cases A-Z; letters and bytes of non-ASCII characters make terms
FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _words(text: bytes, piece: int = 1 << 20):
    """The terms of a text in lists of bounded size, cut where a term ends."""
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + piece)
        while hi < len(text) and FOLD[text[hi]] != 32:
            hi += 1
        yield text[lo:hi].translate(FOLD).split()
        lo = hi


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts of occurrences and documents by task."""
    def rows(batches):
        held, entries = {}, 0

        def out():
            cols = [[], [], [], [], []]
            for (lang, source), (n, d) in held.items():
                cols[0] += [lang] * len(n)
                cols[1] += [source] * len(n)
                cols[2] += n.keys()
                cols[3] += n.values()
                cols[4] += map(d.__getitem__, n)
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()),
                 pa.array(cols[2], pa.binary()).cast(pa.string()),
                 pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
            for lang, source, text in zip(langs, sources, textkit.text_bytes(batch.column("text"))):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), Counter()
                for words in _words(text):
                    own.update(words)
                n.update(own)
                d.update(own.keys())
                entries += len(n) - before
                if entries >= HELD:
                    yield out()
                    held, entries = {}, 0
        if held:
            yield out()

    frame = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return frame.mapInArrow(rows, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, uses: array of (source, n)) of the kept terms, as a written table.
    The list has one entry a source of the language."""
    dealt = term_counts(docs).repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return scratch.store(
        by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"),
                                              F.collect_list(F.struct("source", "n")).alias("uses"))
        .where(F.col("docs") >= least_docs).drop("docs"), "audit_terms")


def group_sizes(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, base): base = N + V, N the group's occurrences of kept terms and V their
    number, of every occurring group; the language itself has a null source."""
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    uses = terms.select("lang", F.explode("uses").alias("use")).groupBy("lang", F.col("use.source").alias("source")).agg(
        F.sum("use.n").alias("n"))
    whole = terms.groupBy("lang").agg(F.sum("total").alias("n"), F.count(F.lit(1)).alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    groups = every.join(uses, ["lang", "source"], "left").join(whole.select("lang", "v"), "lang", "left").select(
        "lang", "source", (zero("n") + zero("v")).alias("base"))
    return scratch.store(groups.unionByName(whole.select("lang", F.lit(None).cast("string").alias("source"),
                                                         (F.col("n") + F.col("v")).alias("base"))), "audit_groups")


def level_price(level: int, base: int) -> int:
    """p of a term with ``level`` occurrences in a group of ``base`` = N + V."""
    return 1 + SCALE * (level + 1) // base


class Block:
    """The products of one block of terms of one language."""

    def __init__(self, sources: list[str], bases: list[int]):
        self.sources, self.bases = sources, bases
        self.index = {s: i for i, s in enumerate(sources)}
        self.starts = range(0, len(sources), GROUPS)
        self.total = {}
        self.clear()

    def clear(self):
        self.terms, self.uses = 0, [[] for _ in self.starts]
        self.columns = [[{0} for _ in self.sources[at:at + GROUPS]] for at in self.starts]
        self.width = [len(c) for c in self.columns]

    def add(self, uses: list[tuple[str, int]]) -> None:
        for source, n in uses:
            part, g = divmod(self.index[source], GROUPS)
            self.uses[part].append((self.terms, g, n))
            levels = self.columns[part][g]
            if n not in levels:
                levels.add(n)
                self.width[part] += 1
        self.terms += 1
        if self.terms >= TERMS or max(self.width) >= COLUMNS:
            self.multiply()

    def indicators(self, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """X of one run of groups, the group of each column and its price."""
        first = part * GROUPS
        code, owner, price = [], [], []
        for g, levels in enumerate(self.columns[part]):
            at = {n: len(owner) + i for i, n in enumerate(sorted(levels))}
            code.append(at)
            owner += [g] * len(at)
            price += [level_price(n, self.bases[first + g]) for n in at]
        column = np.tile([at[0] for at in code], (self.terms, 1))
        for row, g, n in self.uses[part]:
            column[row, g] = code[g][n]
        x = np.zeros((self.terms, len(owner)), np.float32)
        x[np.arange(self.terms)[:, None], column] = 1
        return x, np.array(owner), np.array(price, np.int64)

    def multiply(self) -> None:
        """Adds the block's priced joint tables to the totals of all pairs of groups."""
        if self.terms:
            parts = [self.indicators(i) for i in range(len(self.starts))]
            for i, (x, of, p) in enumerate(parts):
                for j, (y, to, q) in enumerate(parts):
                    joint = (x.T @ y).astype(np.int64)
                    joint *= (p[:, None] - q) ** 2 // q
                    rows = np.add.reduceat(joint, np.flatnonzero(np.diff(of, prepend=-1)), axis=0)
                    cells = np.add.reduceat(rows, np.flatnonzero(np.diff(to, prepend=-1)), axis=1)
                    self.total[i, j] = self.total.get((i, j), 0) + cells
        self.clear()

    def values(self):
        """(source, item, value) of all ordered pairs of groups, after the last block."""
        self.multiply()
        for i in range(len(self.starts)):
            for j in range(len(self.starts)):
                a, b = (self.sources[k * GROUPS:(k + 1) * GROUPS] for k in (i, j))
                cells = self.total.get((i, j), np.zeros((len(a), len(b)), np.int64))
                for g, source in enumerate(a):
                    for h, item in enumerate(b):
                        if source != item:
                            yield source, item, int(cells[g, h])


def _pair_rows(batches):
    """Rows sorted by (part, lang, groups before terms) to the pairs' partial values."""
    at, sources, bases, block = None, [], [], None

    def close():
        if at is not None:
            found = list((block or Block(sources, bases)).values()) if sources else []
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([at[1]] * len(found), pa.string()), pa.array(cols[0], pa.string()),
                 pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["lang", "source", "item", "value"])

    for batch in batches:
        for part, lang, source, base, uses in zip(*(batch.column(c).to_pylist() for c in (
                "part", "lang", "source", "base", "uses"))):
            if (part, lang) != at:
                yield from close()
                at, sources, bases, block = (part, lang), [], [], None
            if uses is None:
                sources.append(source)
                bases.append(base)
            else:
                block = block or Block(sources, bases)
                block.add([(u["source"], u["n"]) for u in uses])
    yield from close()


def source_pairs(terms: DataFrame, groups: DataFrame, part_terms: int = PART_TERMS) -> DataFrame:
    """(lang, source, item, value): how far each source is from each other one of its language."""
    parts = max(1, -(-terms.count() // part_terms))
    heads = groups.where(F.col("source").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "lang", F.lit(-1).cast("long").alias("total"),
        "source", "base", F.lit(None).cast(terms.schema["uses"].dataType).alias("uses"))
    lines = terms.select(F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int").alias("part"), "lang", "total",
                         F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("base"), "uses")
    sums = (heads.unionByName(lines).repartition(parts, "part").sortWithinPartitions("part", "lang", "total", "source")
            .select("part", "lang", "source", "base", "uses")
            .mapInArrow(_pair_rows, "lang string, source string, item string, value long"))
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _p(n: str, base: str) -> Column:
    """level_price in columns: exact, through decimals."""
    return F.expr(f"1 + cast((cast({n} as decimal(19,0)) + 1) * {SCALE} div cast({base} as decimal(19,0)) as long)")


def source_terms(terms: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): the ``top`` terms that a source uses beyond its language."""
    of = groups.where(F.col("source").isNotNull()).select("lang", "source", "base")
    whole = groups.where(F.col("source").isNull()).select("lang", F.col("base").alias("whole"))
    uses = terms.select("lang", F.col("term").alias("item"), "total", F.explode("uses").alias("use")).select(
        "lang", "item", "total", "use.source", "use.n")
    priced = (uses.join(whole, "lang").join(of, ["lang", "source"])
              .withColumn("p", _p("n", "base")).withColumn("q", _p("total", "whole")).where("p > q")
              .select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return priced.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair, term), item, value, rank of every group."""
    terms = kept_terms(docs, least_docs)
    groups = group_sizes(docs, terms)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(terms, groups).withColumn("rank", F.row_number().over(order))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("part", F.lit("pair")).select(*cols)
            .unionByName(source_terms(terms, groups, top).withColumn("part", F.lit("term")).select(*cols)))


def op12_divergence_audit(spark, sf_dir):
    """Op 12 over the whole ``documents`` table."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
uses AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
g AS (SELECT lang, source FROM d GROUP BY lang, source),
base AS (
  SELECT g.lang, g.source, (coalesce(max(v.v), 0) + coalesce(sum(u.n), 0))::HUGEINT AS base
  FROM g LEFT JOIN v ON v.lang = g.lang LEFT JOIN uses u ON u.lang = g.lang AND u.source = g.source
  GROUP BY g.lang, g.source),
p AS (
  SELECT b.lang, b.source, k.term, coalesce(u.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(u.n, 0) + 1) // b.base AS p
  FROM base b JOIN kept k ON k.lang = b.lang
  LEFT JOIN uses u ON u.lang = b.lang AND u.source = b.source AND u.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT s.lang, s.source, t.source AS item, sum((s.p - t.p) * (s.p - t.p) // t.p) AS value
             FROM p s JOIN p t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
q AS (
  SELECT p.lang, p.source, p.term AS item, p.p, 1 + 1000000000::HUGEINT * (k.total + 1) // (v.n + v.v) AS q
  FROM p JOIN kept k ON k.lang = p.lang AND k.term = p.term JOIN v ON v.lang = p.lang WHERE p.n > 0),
term AS (
  SELECT lang, source, item, (p - q) * (p - q) // q AS value FROM q WHERE p > q),
every AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term' AS part, item, value FROM term),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
WHERE part = 'pair' OR rank <= 200
"""
