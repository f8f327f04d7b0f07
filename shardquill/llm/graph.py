"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., 2014).

Each step replaces links by links to smaller ids, so a hub's links are summed before they meet; rounds grow with the
logarithm of a component's size. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): for each id in ``links`` (a, b) the smallest id it reaches. Links to oneself are ignored."""
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).collect()[0]
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = scratch.keep(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        after = scratch.keep(small.where("a <> b").distinct())
        scratch.drop(edges, large)
        edges = after
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
