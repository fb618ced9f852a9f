"""Connected components of a link table by alternating large-star and small-star steps, each a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_staged, staged


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (columns a and b, long).

    Each round moves every node closer to its smallest neighbour; the rounds end when the links no longer change, which
    takes a number logarithmic in the size of the largest component. Links are kept in the shared folder between rounds.
    """

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    links = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = state(links)
    while seen[0]:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        new = staged(moved.union(small.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop_staged(links.sparkSession, links)
        links, before, seen = new, seen, state(new)
        if seen == before:
            break
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
