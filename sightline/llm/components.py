"""Connected components of a link table, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import materialise


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the smallest node of the component.

    Alternates two rounds until the links no longer change: every node sends its larger neighbours to its
    smallest neighbour, then its smaller ones.  Links of a hub are never gathered: each round is one
    pre-aggregated minimum and one join, both tables written to the shared folder, so a lost executor costs
    one round.  The number of rounds grows with the logarithm of the longest chain.
    """
    edges = materialise(_tidy(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "component_links")
    before = None
    for _ in range(max_rounds):
        large = _star(edges.union(edges.select("b", "a")), larger=True)
        edges = materialise(_star(large, larger=False), "component_links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    rooted = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or all smaller) neighbours of each node, as (a, b) with a > b, to its least neighbour."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = edges.join(least, "a")
    if larger:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return _tidy(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
