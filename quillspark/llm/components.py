"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root being the smallest node of its component.

    Rows with a null end are passed over, loops make their node a component of
    its own, and repeated edges count once.  The number of rounds grows with
    the logarithm of the longest path; each is cut from its lineage by a
    checkpoint.
    """
    loops = _spark.checkpoint(edges.where("a is not null and b is not null").select("a", "b"))
    nodes = loops.select(F.col("a").alias("node")).union(loops.select(F.col("b").alias("node"))).distinct()
    links = _spark.checkpoint(loops.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while not links.isEmpty():
        # large star: every larger neighbour of a node goes to the smallest node of the neighbourhood
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour, and the node, go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        links = _spark.checkpoint(small.where("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
