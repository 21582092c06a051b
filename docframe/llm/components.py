"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import discard, materialise


def _written(edges: DataFrame) -> DataFrame:
    return materialise(edges, s=F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node reachable.

    Each step attaches neighbours to the least one; rounds grow with the logarithm of a component's size.
    """
    edges = _written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while edges.seen["n"]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        old, edges = edges, _written(small.filter("a <> b").distinct())
        discard(old)
        if edges.seen == old.seen:
            break
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def joined(component: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: only those that these join are touched."""
    of = lambda c: component.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    mapped = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    over = components(mapped).select(F.col("node").alias("component"), F.col("component").alias("_over"))
    nodes = component.union(mapped.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component")).join(component.select("node"), "node", "left_anti"))
    return nodes.join(over, "component", "left").select("node", F.coalesce("_over", "component").alias("component"))
