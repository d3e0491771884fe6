"""Similarity pairs inside bounded blocks of rows.

Pairs exist only within a block, as within one training batch. Block membership
caps the block size whatever the keys look like, so the number of pairs grows
linearly with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions import keyed_random as R
from peakloom.functions.text import seeded_score
from peakloom.functions.vectors import bin_index
from peakloom.operators.ranking import position_by_score


BUCKET_ROWS = 4096


def with_blocks(rows: DataFrame, record_id: str, block_size: int, seed: int, digits: int | None = None) -> DataFrame:
    """Add `block_id` and `block_row`; a block never exceeds `block_size` rows.

    Rows are spread over hash buckets, then cut into consecutive blocks inside
    each bucket. `digits` hex digits give 16**digits buckets; by default the
    fewest that leave at most about BUCKET_ROWS rows in a bucket. With given
    digits a block does not depend on the size of the table: rows are sorted
    in finer buckets, whose offsets give the place in the whole bucket.
    """
    n, fine = rows.count(), 1
    while 16**fine * BUCKET_ROWS < n:
        fine += 1
    digits = fine if digits is None else digits
    score = seeded_score(F.col(record_id).cast("string"), seed)
    spread = rows.withColumn("_score", score).withColumn("_bucket", F.substring("_score", 1, digits))
    if fine > digits:
        spread = spread.withColumn("_block_bucket", F.col("_bucket")).drop("_bucket", "_score")
        placed = position_by_score(spread, F.coalesce(score, F.lit("")), [F.col(record_id)], by=("_block_bucket",), digits=fine)
        placed = placed.withColumn("_n", F.col("position") - 1).withColumnRenamed("_block_bucket", "_bucket")
        placed = placed.drop("position", "group_size").withColumn("_score", F.lit(None))
    else:
        inside = Window.partitionBy("_bucket").orderBy("_score", record_id)
        placed = spread.withColumn("_n", F.row_number().over(inside) - 1)
    return (
        placed
        .withColumn("block_id", F.concat_ws("-", "_bucket", F.floor(F.col("_n") / block_size).cast("string")))
        .withColumn("block_row", F.pmod("_n", F.lit(block_size)))
        .drop("_score", "_bucket", "_n")
    )


def pairs_within_blocks(blocked: DataFrame, record_id: str, carried: list[str]) -> DataFrame:
    """Each unordered pair of a block once, as an equi-join on the block."""
    def side(suffix):
        return blocked.select(
            "block_id",
            F.col("block_row").alias(f"row_{suffix}"),
            F.col(record_id).alias(f"{record_id}_{suffix}"),
            *[F.col(c).alias(f"{c}_{suffix}") for c in carried],
        )

    return side("a").join(side("b"), "block_id").filter("row_a < row_b")


def capped_per_bin(
    pairs: DataFrame, similarity: Column, bin_size: float, cap: int, seed: int, key: list[str],
    by: tuple[str, ...] = ("block_id",),
) -> DataFrame:
    """At most `cap` pairs per similarity bin, chosen by a keyed random order.

    The cap is the sampling operator itself: balanced bins per batch. Within
    one block a bin is bounded by the block.
    """
    n_bins = int(1.0 / bin_size) + 1
    binned = pairs.withColumn("similarity_bin", bin_index(similarity, 0.0, bin_size, n_bins))
    order = R.digest(seed, "pair", *[F.col(k) for k in key])
    w = Window.partitionBy(*by, "similarity_bin").orderBy(order)
    return binned.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")
