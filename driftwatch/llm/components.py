"""Connected components of links by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (or its smaller) neighbours to the smallest of all it sees.

    The smallest is aggregated before the shuffle; a node of many links meets it
    in a join that AQE splits.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    low = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("low"))
    joined = both.join(low, both.a == low.node)
    if large:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of the links ``(a, b)``, named by its smallest node. No links give no rows.

    Each round writes its links to the shared folder. It ends when the links are stars: each node has one link
    to a node that has none itself. The number of rounds is about logarithmic in the length of chains.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(ordered, "links")
    while not _are_stars(now):
        large = _star(now, True).where("a <> b").distinct()
        now = materialize(_star(large, False).where("a <> b").distinct(), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _are_stars(links: DataFrame) -> bool:
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()
