"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    both = both.select(F.col("high").alias("u"), F.col("low").alias("v"))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = stored(edges.groupBy("high").agg(F.min("low").alias("m")), "star")
    tied = edges.join(least, "high")
    return (
        tied.select(F.col("low").alias("high"), F.col("m").alias("low"))
        .unionByName(least.select("high", F.col("m").alias("low")))
        .where("high <> low")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node in ``a, b``; the component is its least node.

    Nothing but two numbers per round comes to the driver.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "links"
    )
    state = None
    while True:
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
        ).first()
        if tuple(now) == state:
            break
        state = tuple(now)
        if not now[0]:
            break
        edges = stored(_small_star(_large_star(edges)), "links")
    roots = edges.select(F.col("low").alias("node")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
