"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are kept as sums of signed batch deltas.
A batch of changes (``insert``, ``revise`` or ``delete`` of documents) is turned into
signed rows against the counts on record: minus what a document counted so far, plus what
it counts now. Batches form a numbered log. A batch directory holds those document rows
and their small aggregate by key; it is written aside and committed by one rename to the
next free number, so that

* a batch id in the log is never applied again (a redelivered batch is a no-op, and of
  two writers of one batch one wins);
* commits are ordered: a writer whose number was taken meanwhile reads the log again and
  computes its deltas against it, so no two batches subtract the same counts;
* a lost job leaves nothing that readers see;
* totals are read from the aggregates alone; no text is counted twice.

``compact`` folds the first batches of the log, aggregates and document rows, into one
table each; commits and totals start from there and read later batches only.

Tokenizers are named by version and map a text column to a count column, either built-in
functions (``VERSIONS``) or a pandas UDF over a public vocabulary file (:func:`bpe_count`).

Defined cases: of several changes of one document in a batch the last by the column named
in ``order`` wins, without one (and in ties) a delete, then the row with the larger counts,
compared in the order of the version names: one row stands for the document in all
versions. A delete of an unknown document changes nothing; an insert of a known one
revises it; counts of versions this rollup doesn't name stay as they are. Rows without an
id can't be told apart: each one inserted or revised is a document of its own, and a delete
without an id takes all such documents of its source and language, those of its own batch
too. Null and empty texts count 0 tokens and one document; null source or language is a key
of its own; keys whose documents are all gone vanish; an empty batch commits and changes
nothing; other columns aren't read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlane.llm import scratch
from searchlane.llm.op8_mix_sources import n_words
from searchlane.operators.common import bounded_broadcast
from searchlane.session import scratch_path


def n_alnum(text: Column) -> Column:
    """Runs of letters and digits."""
    marks = F.regexp_replace(text, r"[\p{L}\p{Nd}]+", "\u0001")
    return F.coalesce(F.length(F.regexp_replace(marks, "[^\u0001]+", "")), F.lit(0)).cast("long")


VERSIONS: dict[str, Callable[[Column], Column]] = {"space-words-1": n_words, "alnum-runs-1": n_alnum}
KEYS = ("source", "lang", "tokenizer")
DOCUMENTS = "doc_id long, source string, lang string, tokenizer string, n long, sign long"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
LABELS = 2_000_000  # labelled ids that are broadcast; beyond, the join shuffles


def bpe_count(path: str, pattern: str) -> Callable[[Column], Column]:
    """Counts of a byte-pair vocabulary file (token in base64, rank), loaded once a worker."""
    held: dict = {}

    def encoder():
        if not held:
            import tiktoken
            with open(path, "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
            held["e"] = tiktoken.Encoding("rollup", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return held["e"]

    @F.pandas_udf("long")
    def count(texts):
        e = encoder()
        return texts.map(lambda t: len(e.encode_ordinary(t)) if t else 0)

    return count


class TokenRollup:
    """A rollup stored under ``path`` in a folder that all nodes share."""

    def __init__(self, spark: SparkSession, path: str, versions: dict[str, Callable[[Column], Column]] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = versions or VERSIONS
        self._ids: dict[int, str] = {}  # entries of the log never change

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _publish(self, aside: str, final: str) -> bool:
        """Rename once; False, and nothing left behind, if ``final`` exists."""
        fs, src = self._fs(aside)
        _, dst = self._fs(final)
        fs.mkdirs(dst.getParent())
        if not fs.exists(dst) and fs.rename(src, dst) and not fs.exists(self._fs(f"{final}/{src.getName()}")[1]):
            return True
        fs.delete(src, True)
        fs.delete(self._fs(f"{final}/{src.getName()}")[1], True)  # a rename into a directory that won
        return False

    def committed(self) -> list[str]:
        """Batch ids in the order of their commits."""
        fs, p = self._fs(f"{self.path}/batches")
        for entry in fs.listStatus(p) if fs.exists(p) else []:
            number = int(entry.getPath().getName())
            if number not in self._ids:
                name, = (f.getPath().getName() for f in fs.listStatus(self._fs(f"{entry.getPath()}/id")[1]))
                self._ids[number] = unquote(name[2:])
        return [self._ids[i] for i in sorted(self._ids)]

    def _read(self, part: str, schema: str, upto: int) -> DataFrame:
        """Rows of the first ``upto`` batches: the newest fold within them and the batches after it."""
        fs, p = self._fs(f"{self.path}/folded")
        folds = [int(f.getPath().getName()) for f in fs.listStatus(p)] if fs.exists(p) else []
        first = max((n for n in folds if n <= upto), default=0)
        paths = ([f"{self.path}/folded/{first:012d}/{part}"] if first else []) + [
            f"{self.path}/batches/{i:012d}/{part}" for i in range(first, upto)]
        return (self.spark.read.schema(schema).parquet(*paths) if paths
                else self.spark.createDataFrame([], schema))

    def counted(self, changes: DataFrame, order: str | None = None) -> DataFrame:
        """(doc_id, gone, source, lang, tokenizer, n, sign): the change that stands for each document,
        and those without an id by equal counts, ``sign`` of them, a row a tokenizer version."""
        each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), count(F.col("text").cast("string")).alias("n"))
                         for name, count in sorted(self.versions.items())])
        rows = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.col(order) if order else F.lit(0)).alias("at"),
            F.coalesce(F.col("op") == "delete", F.lit(False)).alias("gone"), each.alias("counts"),
            F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
        known = (rows.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
                 .agg(F.max(F.struct("at", "gone", "counts", "source", "lang")).alias("now"))
                 .select("doc_id", "now.gone", "now.source", "now.lang", F.explode("now.counts").alias("c"))
                 .select("doc_id", "gone", "source", "lang", "c.*", F.lit(1).cast("long").alias("sign")))
        loose = (rows.where(F.col("doc_id").isNull()).select("gone", "source", "lang", F.explode("counts").alias("c"))
                 .select("gone", "source", "lang", "c.*").groupBy("gone", "source", "lang", "tokenizer", "n")
                 .agg(F.count(F.lit(1)).alias("sign")))
        return known.unionByName(loose.withColumn("doc_id", F.lit(None).cast("long")))

    def _signed(self, new: DataFrame, upto: int) -> DataFrame:
        """The rows of ``new`` and, negated, those on record in the first ``upto`` batches that they replace."""
        on_record = self._read("documents", DOCUMENTS, upto)
        ids = new.where(F.col("doc_id").isNotNull()).select("doc_id", "tokenizer")
        taken = (new.where("gone AND doc_id IS NULL")
                 .select(F.col("source").alias("s"), F.col("lang").alias("l"), F.col("tokenizer").alias("t")))
        same = (F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l"))
                & (F.col("tokenizer") == F.col("t")))
        old = (on_record.join(ids, ["doc_id", "tokenizer"], "left_semi")
               .unionByName(on_record.where("doc_id IS NULL").join(taken, same, "left_semi"))
               .groupBy("doc_id", *KEYS, "n").agg((-F.sum("sign")).alias("sign")).where("sign <> 0"))
        fresh = new.where("NOT gone").drop("gone")
        return (old.unionByName(fresh.where("doc_id IS NOT NULL"))
                .unionByName(fresh.where("doc_id IS NULL").join(taken, same, "left_anti")))

    def commit(self, batch_id: str, changes: DataFrame, order: str | None = None) -> bool:
        """Apply ``changes`` (doc_id, op, text, source, lang) once; False if the batch is known."""
        if batch_id in self.committed():
            return False
        new = scratch.store(self.counted(changes, order), "rollup_batch")
        done = False
        while not done and batch_id not in (log := self.committed()):
            aside = f"{self.path}/aside/{uuid.uuid4().hex}"
            self._signed(new, len(log)).write.parquet(f"{aside}/documents")
            (self.spark.read.schema(DOCUMENTS).parquet(f"{aside}/documents").groupBy(*KEYS)
             .agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).alias("n_tokens"))
             .write.parquet(f"{aside}/totals"))
            fs, mark = self._fs(f"{aside}/id/b-{quote(batch_id, safe='')}")
            fs.create(mark).close()
            done = self._publish(aside, f"{self.path}/batches/{len(log):012d}")
        scratch.discard(new)
        return done

    def totals(self, upto: int | None = None) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches, or the first ``upto``."""
        rows = self._read("totals", TOTALS, len(self.committed()) if upto is None else upto)
        return (rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
                .where("n_docs <> 0 OR n_tokens <> 0"))

    def compact(self) -> bool:
        """Fold the batches committed so far; False if that is done already."""
        upto = len(self.committed())
        final = f"{self.path}/folded/{upto:012d}"
        fs, p = self._fs(final)
        if not upto or fs.exists(p):
            return False
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        self.totals(upto).write.parquet(f"{aside}/totals")
        (self._read("documents", DOCUMENTS, upto).groupBy("doc_id", *KEYS, "n").agg(F.sum("sign").alias("sign"))
         .where("sign <> 0").write.parquet(f"{aside}/documents"))
        return self._publish(aside, final)


def op1_token_rollup(spark, sf_dir):
    """Op 1: all of ``documents`` are inserted; documents labelled toxic are deleted; those
    labelled low quality are revised to their text without symbols; the deletion is delivered
    again and must change nothing. Returns the totals."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    marks = (spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id")
             .agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")))
    gone = bounded_broadcast(marks.where("toxic = 1").select("doc_id"), LABELS)
    poor = bounded_broadcast(marks.where("quality = 0 AND toxic = 0").select("doc_id"), LABELS)
    deletes = docs.join(gone, "doc_id", "left_semi").select("doc_id", F.lit("delete").alias("op"),
                                                            F.lit(None).cast("string").alias("text"), "source", "lang")
    revises = docs.join(poor, "doc_id", "left_semi").select(
        "doc_id", F.lit("revise").alias("op"), F.regexp_replace("text", r"[|#$%&*!]+", " ").alias("text"), "source", "lang")
    rollup = TokenRollup(spark, scratch_path(spark, "token_rollup"))
    rollup.commit("0-load", docs.withColumn("op", F.lit("insert")))
    rollup.commit("1-takedown", deletes)
    rollup.compact()
    rollup.commit("2-recount", revises)
    rollup.commit("1-takedown", deletes)
    return rollup.totals()


ORACLE = r"""
WITH m AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (SELECT d.source, d.lang,
             CASE WHEN m.quality = 0 THEN regexp_replace(d.text, '[|#$%&*!]+', ' ', 'g') ELSE d.text END AS text
      FROM documents d LEFT JOIN m USING (doc_id) WHERE coalesce(m.toxic, 0) = 0),
c AS (SELECT source, lang, 'space-words-1' AS tokenizer,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM d
      UNION ALL
      SELECT source, lang, 'alnum-runs-1', coalesce(len(regexp_extract_all(text, '[\p{L}\p{Nd}]+')), 0) FROM d)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM c GROUP BY ALL
"""
