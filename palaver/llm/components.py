"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm.common import keep


def stars(links: DataFrame) -> DataFrame:
    """One large and one small star step: every node is hung on the smallest node it sees."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    down = large.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    smallest = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(smallest, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return small.union(smallest.select("u", "m")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b), the component being its smallest node. What each step
    leaves is written to the shared folder, so that lineage stays short."""
    known = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        # Done when every link leads from a node to the root of a star, and no step changes the links.
        now = known.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before or now["n"] == 0:
            break
        before = now
        known = keep(stars(known), "links")
    nodes = known.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(known.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
