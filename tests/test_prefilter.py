"""The bitmap prefilter: no listed key is lost, few others pass, and what is shuffled afterwards is counted."""

import pytest
from pyspark.sql import functions as F

from peakloom.operators import prefilter


@pytest.mark.parametrize("n", [0, 1, 1000, 20_000])
def test_listed_keys_pass_and_few_others(spark, n):
    large = spark.range(200_000).select((F.col("id") % 100_000).cast("string").alias("k"), F.col("id").alias("v"))
    keys = spark.range(n).select((F.col("id") * 3).cast("string").alias("k"))
    passed = prefilter.may_match(large, keys, ["k"])
    assert passed.columns == large.columns
    exact = large.join(keys, "k", "left_semi")
    assert prefilter.keep_matching(large, keys, ["k"]).exceptAll(exact).count() == 0
    found, matches = passed.count(), exact.count()
    assert passed.join(keys, "k", "left_semi").count() == matches
    assert found - matches <= 0.02 * 200_000


def test_null_and_compound_keys(spark):
    schema = "a int, b string, c int"
    large = spark.createDataFrame([(1, "x", 0), (None, "x", 1), (1, None, 2), (2, "y", 3)], schema)
    keys = spark.createDataFrame([(1, "x"), (None, "x")], "a int, b string")
    passed = {r.c for r in prefilter.may_match(large, keys, ["a", "b"]).collect()}
    assert {0, 1} <= passed
    assert {r.c for r in prefilter.keep_matching(large, keys, ["a", "b"]).collect()} == {0}


def test_a_bitmap_over_the_bound_is_not_built(spark):
    assert prefilter.bitmap_bits(10**9) is None and prefilter.bitmap_bits(5_000_000) <= 8 * prefilter.MAX_BYTES
    large, keys = spark.range(100), spark.range(50)
    assert prefilter.may_match(large, keys, ["id"], max_bytes=10).count() == 100
    assert prefilter.keep_matching(large, keys, ["id"], max_bytes=10).count() == 50
