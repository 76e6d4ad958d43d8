"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlane.llm import scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node
    reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is
    an aggregate per node and an equi-join, links are rewritten towards smaller
    neighbours, and the rounds grow with the logarithm of the component sizes. Each
    round is a written table, so a lost executor repeats one round at most. Nothing of
    the graph reaches the driver but two numbers a round. Null ends and self-links are
    ignored; repeated links count once.
    """
    now = scratch.store(
        edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(),
        "links")
    before = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
                 .union(least.select(F.col("m").alias("lo"), "hi")).distinct())
        after = scratch.store(small, "links")
        scratch.discard(now)
        now = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select("lo", "lo")).distinct()
