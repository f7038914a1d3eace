"""Connected components of an edge table by alternating large-star and small-star steps.

Nothing but a change count reaches the driver. Each step is a group minimum (combined before the shuffle)
joined back to its edges. The edges of a hub share a key in that join; they are two longs each, and adaptive execution
splits such a key. Each round ends in a checkpoint of as many parts as its edges need, so a small table makes few files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import checkpoint


#: Edges that one part holds in expectation.
PART_EDGES = 250_000


def _star(pairs: DataFrame) -> DataFrame:
    """u, v, m: each pair with the least of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node, root of the nodes in edges (a, b); root is the least node of its component."""
    now = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())

    def state() -> tuple[int, object]:
        return tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    size = state()
    while size[0]:
        now = now.coalesce(1 + size[0] // PART_EDGES)
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = checkpoint(small.distinct().coalesce(1 + size[0] // PART_EDGES))
        before, size = size, state()
        if before == size:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
