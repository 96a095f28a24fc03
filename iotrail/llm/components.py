"""Connected components of links by alternating large and small stars, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise

LIGHT = 4  # writing tasks a core


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """edges(a, b), a > b. Each node hands its least neighbour to its larger (both) or smaller ones."""
    near = edges.select(F.col("a").alias("v"), F.col("b").alias("u"))
    if both:
        near = near.unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    least = near.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    joined = near.join(least, "v")
    if both:
        return joined.where(F.col("u") > F.col("v")).select(F.col("u").alias("a"), F.col("m").alias("b"))
    moved = joined.where(F.col("u") != F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(a long, b long) in any order, repeated or not -> (node, component), component the least node
    reachable. Nodes without a link to another node do not appear. Rows with a null are ignored.

    No node's links are brought together in a task: minima are pre-aggregated, and the joins are ones that
    adaptive execution splits where a node has very many links.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "links", LIGHT)
    for _ in range(most_rounds):
        old, edges = edges, materialise(_stars(_stars(edges, True), False).distinct(), "links", LIGHT)
        forget(old)
        ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        unsettled = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("root") == 1)))
        if unsettled.isEmpty():  # every node hangs on one root
            break
    else:
        raise RuntimeError("components did not settle")
    out = materialise(
        edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components", LIGHT
    )
    forget(edges)
    return out


def merge(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of all links so far: known are those before, links the new ones."""
    if known is None:
        return components(links)
    mapped = links
    for c in ("a", "b"):
        mapped = mapped.join(known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(c, F.coalesce(f"c{c}", c)).drop(f"c{c}")
    new = components(mapped.select("a", "b"))
    moved = known.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    moved = moved.select("node", F.coalesce("to", "component").alias("component"))
    fresh = new.join(known, "node", "left_anti").select("node", "component")
    out = materialise(moved.unionByName(fresh), "components", LIGHT)
    forget(new)
    return out
