"""Connected components by alternating star contractions (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.session import cut_lineage


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node number reachable from each node.

    ``nodes`` has a column ``node``; ``edges`` has ``a`` and ``b``. Every round
    relinks neighbours to the least of them, so long chains halve, and is
    written out before the next.
    """
    links = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    previous = None
    while True:
        links = _large_star(links)
        links = cut_lineage(_small_star(links))
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == previous:
            break
        previous = state
    return nodes.join(links.select(F.col("a").alias("node"), "b"), "node", "left").select(
        "node", F.coalesce("b", "node").alias("component")
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its least neighbour, itself included."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter("a <> b").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Link each node's smaller neighbours, and itself, to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    smaller = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return smaller.unionByName(own).filter("a <> b").distinct()
