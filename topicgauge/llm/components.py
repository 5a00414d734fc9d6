"""Connected components of a table of links, by alternating star rounds.

In a round every node first points its larger neighbours to the smallest node it sees, then its
smaller ones, itself included. Both steps are one grouped minimum and one join, so a hub with a
large share of all links is summed up before the shuffle and its partition can be split by adaptive
execution. The table of links is written to the shared folder after every round, which cuts the
lineage; its size only shrinks. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgauge.sources.storage import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (u, v) of one star step; u is the node, v what it is linked to."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of the links ``u, v``; the root is the component's smallest node."""
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v"))
    links = materialize(ordered.distinct())
    while True:
        large = _star(links, True)
        stars = materialize(_star(large, False))
        # done when every node has one link and no root is linked itself
        many = stars.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        chained = stars.join(stars.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        links = stars
        if many.isEmpty() and chained.isEmpty():
            break
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
