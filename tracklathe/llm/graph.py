"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklathe.llm._shared import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for the columns a and b, longs, of ``edges``, by alternating stars.

    Every round links each node's larger neighbours, then its smaller ones, to the least it knows (Kiveris et al. 2014),
    in two shuffles of the edges; the rounds needed grow with the logarithm of a component's width. Each round's edges
    are checkpointed.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    near = Window.partitionBy("u")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(near))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.withColumn("m", F.min("v").over(near))
        linked = least.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = checkpointed(linked.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
