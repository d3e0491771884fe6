"""Cross-validation folds that keep groups whole and classes in proportion.

A group (a molecule with all its rows) is described by its vector of rows per
class. Groups of equal vector are interchangeable: they are dealt to the folds
in turn, in a seeded order, so every full round gives all folds the same. What
is left of each vector, fewer groups than folds, is placed by largest deficit.
Only that last step is sequential, and its input does not grow with the rows:
it has one row per distinct vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.text import seeded_score
from peakloom.operators.ranking import position_by_score

MAX_CLASSES = 200
PLACED = "vector array<bigint>, rest bigint, fold int"


def place_remainders(vectors: list[tuple[int, ...]], counts: list[int], folds: int) -> list[tuple[tuple[int, ...], int, int]]:
    """`(vector, which of the rest, fold)` for the groups of each vector beyond full rounds.

    Larger vectors are placed first. Each group goes to the fold that lacks
    most of what the group has: the sum over classes of the group's rows times
    the fold's missing share of the class. Ties go to the fold with fewer rows,
    then to the first.
    """
    classes = len(vectors[0]) if vectors else 0
    totals = [sum(v[c] * n for v, n in zip(vectors, counts, strict=True)) for c in range(classes)]
    whole = prod(max(t, 1) for t in totals)
    share = [whole // max(t, 1) for t in totals]
    dealt = [sum(v[c] * (n // folds) for v, n in zip(vectors, counts, strict=True)) for c in range(classes)]
    have = [list(dealt) for _ in range(folds)]
    found = []
    for vector, n in sorted(zip(vectors, counts, strict=True), key=lambda x: (-sum(x[0]), [-c for c in x[0]])):
        for rest in range(n % folds):
            def lack(f: int, vector=vector) -> tuple[int, int, int]:
                missing = sum(v * (t - folds * h) * s for v, t, h, s in zip(vector, totals, have[f], share, strict=True))
                return missing, -sum(have[f]), -f

            best = max(range(folds), key=lack)
            have[best] = [h + v for h, v in zip(have[best], vector, strict=True)]
            found.append((vector, rest, best))
    return found


def group_folds(rows: DataFrame, key: str, folds: int, seed: int, label: str | None = None) -> DataFrame:
    """`key, fold`: folds from 0 that hold whole groups, each with nearly the same rows of every class.

    Without a label only the number of rows is balanced. Rows without a label
    are a class of their own; rows without a key are one group. An empty table
    gives no rows, fewer groups than folds leave folds empty.
    """
    named = rows.select(F.col(key).alias("_key"), (F.lit(0) if label is None else F.col(label)).alias("_label"))
    found = [r["_label"] for r in named.select("_label").distinct().orderBy("_label").limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    vector = F.array(*[F.count_if(F.col("_label").eqNullSafe(F.lit(c))) for c in found] or [F.lit(0).cast("bigint")])
    groups = named.groupBy("_key").agg(vector.alias("vector"))
    order = seeded_score(F.coalesce(F.col("_key").cast("string"), F.lit("")), seed)
    ranked = position_by_score(groups, order, [F.col("_key")], by=("vector",))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = [r for b in batches for r in b.to_pylist()]
        rest = place_remainders([tuple(r["vector"]) for r in listed], [r["n"] for r in listed], folds)
        columns = [pa.array([list(v) for v, _, _ in rest], pa.list_(pa.int64())), pa.array([j for _, j, _ in rest], pa.int64()),
                   pa.array([f for _, _, f in rest], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["vector", "rest", "fold"])

    strata = groups.groupBy("vector").agg(F.count("*").alias("n"))
    remainders = strata.repartition(1).mapInArrow(placed, PLACED)
    beyond = F.col("position") - 1 - F.col("group_size") + F.col("group_size") % folds
    in_turn = ((F.col("position") - 1) % folds).cast("int")
    dealt = ranked.withColumn("rest", F.when(beyond >= 0, beyond))
    return dealt.join(remainders, ["vector", "rest"], "left").select(
        F.col("_key").alias(key), F.when(F.col("rest").isNull(), in_turn).otherwise(F.col("fold")).alias("fold"))


def fold_shares(rows: DataFrame, assigned: DataFrame, key: str, label: str) -> DataFrame:
    """Rows and groups of each class in each fold."""
    return rows.join(assigned, rows[key].eqNullSafe(assigned[key])).groupBy("fold", label).agg(
        F.count("*").alias("rows"), F.count_distinct(rows[key]).alias("groups"))
