"""Connected components of a graph by alternating star contractions, in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codevitals.session import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of ``edges`` (a, b: long).

    Each round makes every node's larger neighbours, then its smaller ones, point at its smallest neighbour, until every edge leads to a
    smallest node; depth shrinks by more than half a round. Only two numbers a round reach the driver.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Large star: neighbours above a node point at the smallest around it.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large-star")
        # Small star: a node and its smaller neighbours point at the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(small, "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
