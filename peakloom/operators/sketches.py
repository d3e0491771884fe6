"""Distinct counts from mergeable sketches.

Each part of a table (a file, split or source) gets one small HLL and one theta
sketch of its keys, which are stored beside the table. Counts of any union of
parts, and overlaps of parts, then come from the sketches alone; rows are read
once. Estimates have a bound, which `bounded` compares with an exact count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-two logarithms of the sketch sizes.
HLL_SIZE, THETA_SIZE = 14, 13
#: Deviations that an estimate may be off.
WIDTH = 5


def key_sketches(rows: DataFrame, part: str, key: str) -> DataFrame:
    """`part, hll, theta`: sketches of the distinct non-empty keys of each part."""
    some = F.when(F.col(key).cast("string") != "", F.col(key).cast("string"))
    return rows.groupBy(part).agg(
        F.hll_sketch_agg(some, F.lit(HLL_SIZE)).alias("hll"), F.theta_sketch_agg(some, F.lit(THETA_SIZE)).alias("theta"))


def union_estimate(sketches: DataFrame) -> DataFrame:
    """`estimate`: distinct keys of all parts together."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("estimate"))


def merged(sketches: DataFrame, by: Column, name: str) -> DataFrame:
    """Sketches of coarser parts, from those of finer ones."""
    return sketches.groupBy(by.alias(name)).agg(F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", THETA_SIZE).alias("theta"))


def overlap_estimates(sketches: DataFrame, part: str, pairs: list[tuple]) -> DataFrame:
    """`left, right, estimate, bound`: keys that both parts of each listed pair have, and how far the estimate may be off.

    An intersection is as uncertain as the union that it is taken from is large.
    """
    spark = sketches.sparkSession
    kind = sketches.schema[part].dataType.simpleString()
    wanted = spark.createDataFrame(pairs, f"left {kind}, right {kind}")
    for side in ("left", "right"):
        wanted = wanted.join(sketches.select(F.col(part).alias(side), F.col("theta").alias(f"_{side}")), side)
    both = F.theta_sketch_estimate(F.theta_intersection("_left", "_right"))
    either = F.theta_sketch_estimate(F.theta_union("_left", "_right", F.lit(THETA_SIZE)))
    # the share of the union is a proportion among the retained hashes, fewer where all hashes are retained
    bound = WIDTH * F.sqrt(F.greatest(both, F.lit(1)).cast("double") * either / F.lit(float(1 << THETA_SIZE))) + 1
    exact = either < (1 << THETA_SIZE)
    return wanted.select("left", "right", both.alias("estimate"), F.when(exact, F.lit(1.0)).otherwise(bound).alias("bound"))


def hll_bound(count: Column) -> Column:
    return WIDTH * 1.04 / float(1 << (HLL_SIZE // 2)) * count + 1


def bounded(estimate: Column, exact: Column, bound: Column) -> Column:
    """Whether an estimate lies within its bound of the exact count."""
    return F.abs(estimate - exact).cast("double") <= bound
