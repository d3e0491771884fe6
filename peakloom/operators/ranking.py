"""Exact global positions and running totals without one-task windows.

A window without a partition key sorts a whole table in one task. Here rows are
first put into order-preserving buckets; bucket sums (a few thousand rows) give
each bucket its offset, and the ordering inside a bucket runs in parallel.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def totals_before(
    df: DataFrame,
    bucket: str,
    order: list[Column],
    weights: dict[str, Column],
    by: tuple[str, ...] = (),
    below: dict[str, Column] | None = None,
) -> DataFrame:
    """Add `<name>_before` and `<name>_total` for every weight.

    `bucket` must order like `order`. `_before` sums the rows strictly earlier
    within the group, `_total` sums the whole group. `below` keeps only rows
    with `<name>_before` under a bound, which may use the totals: buckets that
    start beyond it are left out before anything is sorted. A null group is a
    group like any other; a row without a bucket (no key or score) fails the job.
    """
    lost = F.raise_error(F.lit("a row has no key or score to order by")).cast("boolean")
    placed = df.filter(F.when(F.col(bucket).isNull(), lost).otherwise(True))
    weighted = placed.withColumns({f"_w_{name}": w for name, w in weights.items()})
    sums = weighted.groupBy(*by, bucket).agg(
        *[F.sum(f"_w_{name}").alias(f"_b_{name}") for name in weights]
    )
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"_g_{c}") for c in by],
        F.col(bucket).alias("_g_bucket"),
        *[F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in weights],
        *[F.sum(f"_b_{n}").over(whole).alias(f"{n}_total") for n in weights],
    )
    inside = (
        Window.partitionBy(*by, bucket)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    matched = reduce(lambda a, b: a & b, same, F.col(bucket) == F.col("_g_bucket"))
    joined = weighted.join(offsets, matched).drop("_g_bucket", *[f"_g_{c}" for c in by])
    for n, bound in (below or {}).items():
        joined = joined.filter(F.col(f"_o_{n}") < bound)
    summed = (
        joined
        .withColumns({
            f"{n}_before": F.col(f"_o_{n}")
            + F.coalesce(F.sum(f"_w_{n}").over(inside), F.lit(0))
            for n in weights
        })
        .drop(*[f"_w_{n}" for n in weights], *[f"_o_{n}" for n in weights])
    )
    for n, bound in (below or {}).items():
        summed = summed.filter(F.col(f"{n}_before") < bound)
    return summed


def position_by_score(
    df: DataFrame,
    score: Column,
    ties: list[Column],
    by: tuple[str, ...] = (),
    digits: int = 4,
    at_most: Column | None = None,
) -> DataFrame:
    """Add `position` (1-based) and `group_size` in order of a hex score.

    Hex digests are uniform, so their first digits are balanced buckets: with
    four of them a bucket of 10^10 rows has about 150,000. The positions do not
    depend on the number of digits, and buckets without rows cost nothing.
    `at_most` keeps the first positions only; it may use `group_size`.
    """
    scored = df.withColumn("_score", score).withColumn(
        "_bucket", F.substring("_score", 1, digits)
    )
    ranked = totals_before(
        scored, "_bucket", [F.col("_score"), *ties], {"group_size": F.lit(1)}, by,
        None if at_most is None else {"group_size": at_most},
    )
    return (
        ranked.withColumn("position", F.col("group_size_before") + 1)
        .drop("group_size_before", "_score", "_bucket")
        .withColumnRenamed("group_size_total", "group_size")
    )


MOST_BUCKETS = 8192


def with_value_buckets(rows: DataFrame, reduced: DataFrame, column: str, least: int, per_bucket: int) -> DataFrame:
    """`reduced` with `_bucket`, order-preserving buckets of a column by approximate quantiles of `rows`.

    There are `least` buckets, or more where there are over `per_bucket`
    distinct values for each. One pass reads the column for both questions and
    keeps sketches of bounded size; only columns of very many values take a
    second one for finer quantiles.
    """
    def cuts(n: int) -> Column:
        return F.percentile_approx(column, [i / n for i in range(1, n)], 3 * n)

    found = rows.agg(F.approx_count_distinct(column).alias("n"), cuts(least).alias("cuts")).first()
    wanted = min(MOST_BUCKETS, found["n"] // per_bucket)
    splits = rows.agg(cuts(wanted).alias("cuts")).first()["cuts"] if wanted > least else found["cuts"]
    inner = sorted({s for s in splits or [] if math.isfinite(s)})
    if not inner:
        return reduced.withColumn("_bucket", F.lit(0.0))
    stage = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol=column, outputCol="_bucket", handleInvalid="keep")
    return stage.transform(reduced)


def average_rank(by: list[str], value: str, descending: Column | bool = True) -> Column:
    """Rank with ties averaged inside small comparison groups.

    `descending` may be a column that differs between groups (errors rank
    upward, scores downward). A group holds one row per compared method; a
    method without a value has no rank and counts for nobody else's.
    """
    signed = (
        F.when(descending, -F.col(value)).otherwise(F.col(value))
        if isinstance(descending, Column)
        else (-F.col(value) if descending else F.col(value))
    )
    ordered = Window.partitionBy(*by).orderBy(signed.asc_nulls_last())
    tied = Window.partitionBy(*by, value)
    averaged = F.rank().over(ordered) + (F.count("*").over(tied) - 1) / F.lit(2.0)
    return F.when(F.col(value).isNotNull(), averaged)
