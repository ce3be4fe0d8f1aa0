"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.text import kept, looked_up


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, root): each linked node but the roots, with its component's smallest node.

    Each round points every neighbour at the smallest one, seen from larger and
    then from smaller neighbours; the rounds grow with the logarithm of the
    longest path.  Edges stay distributed and are checkpointed every round; only
    a count and a checksum come to the driver.  Minima are partly aggregated
    before the shuffle, and a hub's minimum is brought to its edges by a broadcast (``looked_up``).
    """
    e = kept(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = e.union(e.select("v", "u"))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times")).select("u", F.least("u", "m").alias("m"), "times"))
        large = kept(looked_up(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # A node has few smaller neighbours left, as all of one hub are the same by now.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = kept(small.union(least.select("u", F.col("m").alias("v"))).distinct())
