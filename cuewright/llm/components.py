"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is its component's smallest node.

    Each round links a node's neighbours to its least neighbour (Kiveris and others, 2014), which
    never makes more edges than there are, settles always, and needs about log(n) rounds.  Rounds are
    checkpointed in the shared folder.
    """
    pairs = checkpoint(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large star: neighbours larger than a node move to the least of its neighbours and itself
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # small star: a node's smaller neighbours and itself move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        pairs = checkpoint(moved)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
