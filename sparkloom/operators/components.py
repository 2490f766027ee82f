"""Connected components of an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root being its component's smallest node; a node whose edges
    all lead to itself is its own root, and edges with a null are left out.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until the edges stay the same, however many
    steps that takes: in the order of log^2 of the nodes at worst. Each step is one aggregation and one join; nothing
    is collected but a count and a checksum of the edges.
    """
    every = written(edges.filter("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    alone, e, held, before = written(every.filter("a = b").select("a")), every.filter("a <> b"), every, None
    while (now := e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before:
        before = now
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
        e = written(small.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), held)
        held = e
    roots = e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")))
    return roots.unionByName(alone.select(F.col("a").alias("node"), F.col("a").alias("root")).join(roots.select("node"), "node", "left_anti")).distinct()
