"""Grouped stratified folds: groups whole, classes in proportion, independent of partitions."""

import random

import pytest
from pyspark.sql import functions as F

from peakloom.operators import folds


def made(spark, seed, n, classes):
    draw = random.Random(seed)
    rows = []
    for g in range(n):
        kind = draw.randrange(classes)
        rows += [(f"g{g}", kind if draw.random() < 0.8 else draw.randrange(classes)) for _ in range(draw.choice([1, 1, 1, 2, 3, 7]))]
    return rows, spark.createDataFrame(rows, "k string, y int").repartition(5)


@pytest.mark.parametrize("classes,k", [(2, 5), (3, 4), (1, 3)])
def test_shares(spark, classes, k):
    rows, table = made(spark, classes, 400, classes)
    fold = {r.k: r.fold for r in folds.group_folds(table, "k", k, 42, "y").collect()}
    assert len(fold) == 400 and set(fold.values()) == set(range(k))
    largest = max(sum(1 for x in rows if x[0] == g) for g in fold)
    for c in range(classes):
        counts = [sum(1 for g, y in rows if y == c and fold[g] == f) for f in range(k)]
        assert max(counts) - min(counts) <= 2 * largest
    again = {r.k: r.fold for r in folds.group_folds(table.repartition(3), "k", k, 42, "y").collect()}
    assert again == fold != {r.k: r.fold for r in folds.group_folds(table, "k", k, 43, "y").collect()}


def test_remainders_go_where_most_is_missing():
    placed = folds.place_remainders([(1, 0), (0, 1), (4, 1)], [5, 3, 1], 3)
    have = [[1 + 0, 1] for _ in range(3)]  # a full round of the first two vectors
    assert placed[0] == ((4, 1), 0, 0)
    for vector, _, f in placed:
        have[f] = [a + b for a, b in zip(have[f], vector)]
    assert sorted(h[0] for h in have) == [2, 2, 5]
    assert folds.place_remainders([], [], 3) == []


def test_odd_keys_and_labels(spark):
    table = spark.createDataFrame([(None, 1), (None, 0), ("a", None), ("b", 1), ("b", None)], "k string, y int")
    found = folds.group_folds(table, "k", 2, 1, "y").collect()
    assert sorted(str(r.k) for r in found) == ["None", "a", "b"] and {r.fold for r in found} == {0, 1}
    assert folds.group_folds(table.limit(0), "k", 2, 1, "y").collect() == []
    sizes = folds.group_folds(table, "k", 3, 1).collect()
    assert sorted(r.fold for r in sizes) == [0, 1, 2]
    shares = folds.fold_shares(table, folds.group_folds(table, "k", 2, 1, "y"), "k", "y")
    assert shares.agg(F.sum("rows")).first()[0] == 5


def test_too_many_classes_are_refused(spark):
    with pytest.raises(ValueError, match="classes"):
        folds.group_folds(spark.range(300).select(F.col("id").alias("k"), F.col("id").alias("y")), "k", 2, 1, "y")
