"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """`node, root` for every node of `links (a, b)` that is not the smallest of its component.

    Each round links every neighbour of a node to the smallest of them, first
    upward (large star), then downward (small star), until all components are
    stars; the number of rounds grows with the logarithm of the longest path.
    Neighbourhoods are only reduced by key, never gathered, and each round is
    written to the shared folder. Self-links and repeated links do no harm.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = staged(ordered.filter(F.col("a") != F.col("b")).distinct(), "stars")
    while not _settled(stars):
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b")))
        )
        stars = staged(small.distinct(), "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one link, to a node without a link of its own."""
    per_node = stars.groupBy("a").agg(F.count("*").alias("n"))
    chained = stars.select(F.col("b").alias("a")).distinct().join(stars.select("a"), "a", "left_semi")
    return not per_node.filter(F.col("n") > 1).limit(1).count() and not chained.limit(1).count()
