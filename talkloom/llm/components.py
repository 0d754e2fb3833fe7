"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.sources.scratch import written


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _to_lowest(rows: DataFrame) -> DataFrame:
    """Rows (node, other), each with the lowest node of its group, the node included."""
    lowest = rows.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return rows.join(lowest, "a")


def components(links: DataFrame) -> DataFrame:
    """(node, component): each linked node with the lowest node that it reaches.

    ``links`` has columns a and b of type long; loops, repeats and either direction are
    fine. Rounds of large-star and small-star steps (Kiveris et al. 2014) turn every
    component into a star around its lowest node. A step takes minima, which combine
    before the shuffle, and joins them back, so the node of a hot group spreads over
    tasks like any skewed join key. Each round is a written table.
    """
    edges = written(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    while True:
        # Large star: larger neighbours move to the lowest one.
        large = (
            _to_lowest(_both_ways(edges))
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        # Small star: the node and its smaller neighbours move to the lowest of them.
        stars = _to_lowest(large)
        small = (
            stars.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(stars.select("a", F.col("low").alias("b")))
            .where("a <> b")
            .distinct()
        )
        after = written(small, "stars")
        # Stars: no node with a lower neighbour is itself the lower neighbour of another one.
        if after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() and (
            after.groupBy("a").count().where("count > 1").isEmpty()
        ):
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        edges = after
