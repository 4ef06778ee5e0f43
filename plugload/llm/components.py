"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plugload.session import materialized


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); the component is the smallest node that can be reached.

    Every round is a minimum per node, which combines before the shuffle, and joins back on the node. Adaptive
    execution splits the join of a node with very many links. Rounds are written to the shared folder, so lineage
    stays short; two numbers per round reach the driver. Self links and repeated links do no harm, null ends are
    ignored, and an empty table gives an empty result.
    """
    ends = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialized(ends.where(F.col("a") != F.col("b")).distinct())
    seen = None
    while (state := _state(edges)) != seen:
        seen = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialized(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = materialized(small.union(least).distinct())
    centres = edges.select(F.col("b").alias("node")).distinct()
    return edges.toDF("node", "component").union(centres.select("node", F.col("node").alias("component")))


def _state(edges: DataFrame) -> tuple:
    mixed = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), mixed).first())
