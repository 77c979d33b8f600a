"""Connected components of large link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.workspace import store


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); component is the smallest node.

    Alternating large and small stars: a node hands its larger, then its smaller
    neighbours to the smallest it knows.  Each round sends a row per link and
    direction, folded on the map side, so a node of any degree is no hot spot for
    the minimum; links never grow in number.  Each round is a written table.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.where("u <> v").distinct(), label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = store(small.select("e.*").where("u <> v").distinct(), label)
        # Done when every node has one link and points to a node that has none.
        sides = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("s"))
        sides = sides.groupBy("s.x").agg(F.sum("s.out").alias("out"), F.max("s.into").alias("into"))
        if sides.where("out > 1 OR (out > 0 AND into > 0)").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
