"""Licence scans by canonical digests.

A text is brought to a canonical form: copyright lines go, letters fall to lower case,
equivalent spellings become one, every run of other characters becomes one space. The md5
of the canonical form is hash-joined to the digests of known licences, for the whole text
and for each of its lines (licence notices). A wrapped sentence can start a line with 'copyright
holder', and lose it; texts with such words are looked up a second time with the words marked
as prose, so that wrapping doesn't matter. Known licences are a table (licence id, text): the
texts of ``licences/`` with their usual titles, see :mod:`searchlane.llm.licence_texts`, and
the notices below. Everything is a column expression; the known digests are broadcast after
a check of their number, so neither texts nor digests move.

Defined cases: null and empty texts, and texts of copyright lines only, have an empty form
and match nothing; repeated known texts count once; a digest known under several names
takes the first by code point; repeated rows give one row each; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlane.llm import licence_texts, scratch
from searchlane.operators.common import bounded_broadcast

KNOWN = 200_000  # known digests that are broadcast; beyond, the join shuffles

COPYRIGHT_LINE = r"^[^\p{L}\p{N}\n]*(copyright\b|\(c\)|©)[^\n]*"

# Words of a sentence, and item (c) of a list, that look like a notice where a line starts with them.
PROSE = (r"(?i)(copyrights?[^\p{L}\p{N}]{1,8}(?:holders?|owners?|ownership|patents?|licen[cs]es?|notices?|laws?|interests?|"
         r"line|doctrines?|protection|statements?|treaty|and|or|on|of|for|that|which|is|in|to|disclosed)\b|"
         r"\(c\)\s+(?:you|under|representations|contributor|the\s+licen[cs]es)\b)")

# Spellings that licence matching guidelines treat as the same, British or split form first.
SPELLINGS = (
    ("licenc", "licens"), ("sub licens", "sublicens"), ("organis", "organiz"), ("authoris", "authoriz"),
    ("recognis", "recogniz"), ("utilis", "utiliz"), ("initialis", "initializ"), ("analyse", "analyze"),
    ("analogue", "analog"), ("artefact", "artifact"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("judgement", "judgment"), ("labour", "labor"), ("programme", "program"),
    ("wilful", "willful"), ("whilst", "while"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
)

# Known licence texts and notices, by SPDX identifier; the oracle knows these.
LICENCES = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
             "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
             "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
             "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
             "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
            "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
            "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
            "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
            "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("NONE-reserved", "All rights reserved."),
)


def canonical(text: Column) -> Column:
    """Canonical form; the spelling rules run only where one of them applies."""
    bare = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?imd){COPYRIGHT_LINE}", ""))
    plain = F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))
    one = plain
    for old, new in SPELLINGS:
        one = F.replace(one, F.lit(old), F.lit(new))
    return F.when(plain.rlike("|".join(old for old, _ in SPELLINGS)), one).otherwise(plain)


def prose_marked(text: Column) -> Column:
    """``text`` whose sentences aren't taken for copyright lines, wherever their lines break."""
    return F.regexp_replace(text, PROSE, "x $1")


def known_licences(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the licences that come with the package."""
    return spark.createDataFrame(licence_texts.known(LICENCES), "license_id string, text string")


def digests(known: DataFrame) -> DataFrame:
    """(digest, license_id) with one row a digest, of texts as they are and with prose marked."""
    both = known.select("license_id", F.explode(F.array("text", prose_marked(F.col("text")))).alias("text"))
    form = both.select("license_id", canonical(F.col("text")).alias("form")).where("form <> ''")
    return form.groupBy(F.md5("form").alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row a row of ``docs``: doc_id, digest of the whole text, license_id it equals (or
    null), and notices, the sorted identifiers of the lines that equal a known text."""
    keys = bounded_broadcast(scratch.store(digests(known), "licence_keys"), KNOWN)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x != ""), lambda x: F.md5(canonical(x)))
    marked = scratch.store(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(canonical(text)).alias("digest"),
                    F.when(text.rlike(PROSE), F.md5(canonical(prose_marked(text)))).alias("again"),
                    F.transform(lines, F.unhex).alias("lines"))
        .withColumn("rid", F.monotonically_increasing_id()), "licence_digests")
    notices = (marked.select("rid", F.explode("lines").alias("line"))
               .join(keys.select(F.unhex("digest").alias("line"), F.col("license_id").alias("notice")), "line")
               .groupBy("rid").agg(F.array_sort(F.collect_set("notice")).alias("notices")))
    second = keys.select(F.col("digest").alias("again"), F.col("license_id").alias("second"))
    return (marked.drop("lines").withColumn("again", F.coalesce("again", "digest")).join(keys, "digest", "left").join(second, "again", "left").join(notices, "rid", "left")
            .select("doc_id", "digest", F.coalesce("license_id", "second").alias("license_id"),
                    F.coalesce(F.array_join("notices", ","), F.lit("")).alias("notices")))


def op2_license_digest(spark, sf_dir):
    """Op 2 over the whole ``documents`` table and the licences that come with the package."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), known_licences(spark))


def _sql_form(x: str) -> str:
    form = f"trim(regexp_replace(lower(regexp_replace(coalesce({x}, ''), '(?im){COPYRIGHT_LINE}', '', 'g')), " \
           "'[^\\p{L}\\p{N}]+', ' ', 'g'))"
    for old, new in SPELLINGS:
        form = f"replace({form}, '{old}', '{new}')"
    return form


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE = f"""
WITH licences(license_id, text) AS (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in LICENCES)}),
known AS (SELECT md5(form) AS digest, min(license_id) AS license_id
          FROM (SELECT license_id, {_sql_form("text")} AS form FROM licences) WHERE form <> '' GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents),
notice AS (SELECT l.doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices
           FROM (SELECT doc_id, md5({_sql_form("x")}) AS digest FROM line WHERE x <> '') l JOIN known k USING (digest)
           GROUP BY l.doc_id),
whole AS (SELECT doc_id, md5({_sql_form("text")}) AS digest FROM documents)
SELECT w.doc_id, w.digest, k.license_id, coalesce(n.notices, '') AS notices
FROM whole w LEFT JOIN known k USING (digest) LEFT JOIN notice n USING (doc_id)
"""
