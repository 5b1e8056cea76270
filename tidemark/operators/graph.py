"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """node, root for the nodes of ``edges`` (a, b): root is the smallest node that can be reached.

    Each round links a node's neighbours to the smallest of them and is written to the checkpoint folder; the rounds
    needed grow with the logarithm of the longest path. Only counts and a hash sum reach the driver. Loops and
    repeated edges are allowed; no edges give no rows.
    """
    pair = lambda a, b: F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = cut(edges.where("a <> b").select(pair(F.col("a"), F.col("b")).alias("e")).select("e.u", "e.v").distinct())
    seen = None
    while (mark := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != seen:
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(pair(F.col("u"), F.col("m")), pair(F.col("v"), F.col("m")))).alias("e"))
        now = cut(small.select("e.u", "e.v").where("u <> v").distinct())
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
