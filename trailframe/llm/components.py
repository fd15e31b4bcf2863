"""Connected components of links by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.runtime import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` links; the root is the component's least node.

    Every round hangs nodes on the least neighbour they know; the rounds grow
    with the logarithm of a component's diameter. A round is a written table,
    no node ever gathers its neighbours, and nothing but a count goes to the
    driver.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # Large star: neighbours greater than a node go to the least of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join's own exchange carries a hub's edges and can be split.
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "large-star")
        # Small star: smaller neighbours and the node itself go to the least of them.
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        joined = large.join(low, "a")
        small = materialize(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(),
            "small-star",
        )
        changed = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        edges = small
        if changed:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
