"""Exact quantiles of whole tables, per group, without gathering a group's values.

Doubles become whole numbers in the same order. The ranks on both sides of each
quantile are then found 16 bits at a time: counts per leading bits tell in which
bin a rank lies, and only rows of such bins are counted again by their next
bits. A group never has more than 65,536 counts per wanted bin in one task, and
four passes over the written keys settle every rank exactly.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.session import cut_lineage

BITS = 16
_LOW = np.int64((1 << 63) - 1)


def order_key(value: Column) -> Column:
    """Whole numbers in the order of the doubles; -0.0 and 0.0 are equal."""
    @F.arrow_udf("bigint")
    def key(values: pa.Array) -> pa.Array:
        bits = (values.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
        return pa.array(bits ^ ((bits >> 63) & _LOW))

    return key(value)


def order_value(key: Column) -> Column:
    """The double of an order key."""
    @F.arrow_udf("double")
    def value(keys: pa.Array) -> pa.Array:
        bits = keys.to_numpy(zero_copy_only=False)
        return pa.array((bits ^ ((bits >> 63) & _LOW)).view(np.float64))

    return value(key)


def _same(left: dict[str, Column], right: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in left])


def exact_quantiles(rows: DataFrame, value: str, probabilities: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """`by, n, quantiles`: count and interpolated quantiles of the values of each group.

    Nulls and NaN do not count; infinite values do. Quantile p lies between the
    values of the ranks around p * (n - 1), in proportion. A null group is a
    group; groups without values give no row. With no `by` there is one row,
    or none for a table without values. Tables are written to the shared
    folder in between.
    """
    if not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    v = F.col(value).cast("double")
    group = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    sound = rows.filter(v.isNotNull() & ~F.isnan(v)).select(*group, v.alias("_v"))
    keys = cut_lineage(sound.select(*names, order_key(F.col("_v")).alias("_k")))
    counts = keys.groupBy(*names).agg(F.count("*").alias("_n")).filter("_n > 0")
    place = [(F.col("_n") - 1).cast("double") * F.lit(float(p)) for p in probabilities]
    wanted = F.explode(F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(s).alias("_side"), (F.floor(h) if s == 0 else F.ceil(h)).cast("bigint").alias("_rank"),
                 (h - F.floor(h)).alias("_part"))
        for i, h in enumerate(place) for s in (0, 1)]))
    targets = counts.select(*names, "_n", wanted.alias("_t")).select(*names, "_n", "_t.*").withColumn("_prefix", F.lit(None).cast("bigint"))
    for shift in range(64 - BITS, -1, -BITS):
        bins = F.shiftright("_k", shift).alias("_bin")
        if shift == 64 - BITS:
            counted = keys.groupBy(*names, bins).agg(F.count("*").alias("_c")).withColumn("_parent", F.lit(None).cast("bigint"))
        else:
            open_ = targets.select(*[F.col(c).alias(f"{c}t") for c in names], F.col("_prefix").alias("_open")).distinct()
            held = keys.join(open_, _same(
                {c: F.col(c) for c in names} | {"_": F.shiftright("_k", shift + BITS)}, {c: F.col(f"{c}t") for c in names} | {"_": F.col("_open")}))
            counted = held.groupBy(*names, F.col("_open").alias("_parent"), bins).agg(F.count("*").alias("_c"))
        before = Window.partitionBy(*names, "_parent").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        ranges = counted.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        ranges = ranges.select(*[F.col(c).alias(f"{c}r") for c in names], "_parent", "_bin", "_before", "_c")
        inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c"))
        same = _same({c: F.col(c) for c in names} | {"_": F.col("_prefix")}, {c: F.col(f"{c}r") for c in names} | {"_": F.col("_parent")})
        targets = cut_lineage(targets.join(ranges, same & inside).select(
            *names, "_n", "_i", "_side", (F.col("_rank") - F.col("_before")).alias("_rank"), "_part", F.col("_bin").alias("_prefix")))
    found = targets.select(*names, "_n", "_i", "_side", "_part", order_value(F.col("_prefix")).alias("_v"))
    ends = found.groupBy(*names, "_n", "_i", "_part").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_b"))
    # equal neighbours, infinite ones among them, are taken as they are
    between = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part"))
    listed = ends.groupBy(*names, "_n").agg(F.array_sort(F.collect_list(F.struct("_i", between.alias("_q")))).alias("_l"))
    return listed.select(
        *[F.col(g).alias(c) for g, c in zip(names, by, strict=True)], F.col("_n").alias("n"), F.col("_l._q").alias("quantiles"))
