import hashlib

import pytest
from pyspark.sql import functions as F

from peakloom.operators import cohort as C
from peakloom.operators import split as S


def score(key, seed):
    return hashlib.sha256(f"{seed}\0{key}".encode()).digest()[:8]


def keyed(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


@pytest.mark.parametrize("n, fraction", [(2, 0.9), (5, 0.5), (7, 0.5), (40, 0.8)])
def test_fraction_split_matches_definition_in_any_order(spark, n, fraction):
    keys = [f"k{i}" for i in range(n)]
    order = sorted(keys, key=lambda k: hashlib.sha256(f"42:{k}".encode()).hexdigest())
    size = min(max(round(n * fraction), 1), n - 1)
    for rows in (keys, keys[::-1] + keys):
        found = C.fraction_split(keyed(spark, rows).repartition(5), "key", fraction, 42).collect()
        assert {r.key for r in found if r.split == "train_val"} == set(order[:size])
        assert len(found) == n
    with pytest.raises(Exception, match="at least two keys"):
        C.fraction_split(keyed(spark, ["one"]), "key", 0.5, 42).collect()


@pytest.mark.parametrize("target", [1, 7, 100, 140, 10_000])
def test_lowest_records_with_a_hot_key(spark, target):
    keys = ["hot"] * 100 + [f"k{i % 70}" for i in range(200)]
    ranked = sorted(keys, key=lambda k: (score(k, 7), [-ord(c) for c in k]))
    found = {r.key for r in S.lowest_records(keyed(spark, keys).repartition(6), "key", target, 7).collect()}
    assert found == set(ranked[:target])


def test_shared_holdout_keeps_molecules_on_one_side(spark):
    sources = {n: keyed(spark, ["shared", *[f"{n}{i}" for i in range(9)]]) for n in "abc"}
    held = S.shared_holdout(sources, {"a": 2, "b": 1, "c": 1}, "key", 7)
    sides = {n: S.apply_holdout(df, held, "key") for n, df in sources.items()}
    train = {r.key for df in sides.values() for r in df.filter("split = 'train'").collect()}
    validation = {r.key for df in sides.values() for r in df.filter("split = 'validation'").collect()}
    assert not train & validation
    assert sum(df.count() for df in sides.values()) == 30


def test_first_keys_and_shortage(spark):
    keys = [f"k{i}" for i in range(30)]
    order = sorted(keys, key=lambda k: (score(k, 42), k))
    rows = S.first_keys(keyed(spark, keys), "key", {"train": 10, "validation": 5}, 42).collect()
    assert [r.key for r in sorted(rows, key=lambda r: r.position)] == order[:15]
    assert {r.key for r in rows if r.split == "train"} == set(order[:10])
    with pytest.raises(Exception, match="too few eligible keys: 30"):
        S.first_keys(keyed(spark, keys), "key", {"train": 31}, 42).collect()


def test_stratified_quota(spark):
    rows = [(f"{s}{i}", s) for s in "xyz" for i in range(10)]
    strata = S.source_strata(spark.createDataFrame(rows, "key string, source string"), "key")
    picks = [{(r.key, r.split) for r in S.stratified_quota(strata.repartition(n), "key", {"train": 12, "eval": 6}, 7).collect()} for n in (1, 5)]
    assert picks[0] == picks[1]
    for s in "xyz":
        assert sorted(split for key, split in picks[0] if key[0] == s) == ["eval"] * 2 + ["train"] * 4
    mixed = spark.createDataFrame([("m", "b"), ("m", "a"), ("m", "b"), ("n", "a")], "key string, source string")
    assert {r.key: (r.stratum, r.records) for r in S.source_strata(mixed, "key").collect()} == {"m": ("a=1;b=2", 3), "n": ("a=1", 1)}


def test_grouped_holdout_and_folds(spark):
    rows = spark.createDataFrame([(f"k{i % 40}", i % 2) for i in range(80)], "key string, y int")
    for label in (None, "y"):
        found = S.grouped_holdout(rows, "key", 0.25, 42, label)
        assert found.count() == 40 and found.filter("split = 'validation'").count() == 10
    folds = rows.select("key", S.fold_number(F.col("key"), 4, 42).alias("fold"))
    assert folds.distinct().count() == 40 and folds.filter("fold < 0 or fold > 3").count() == 0


def test_mixture_quota_and_cycling(spark):
    rows = [(f"a{i}", "a") for i in range(90)] + [(f"b{i}", "b") for i in range(7)] + [("c0", "c")]
    df = spark.createDataFrame(rows, "record_id string, source string")
    picks = [sorted(map(tuple, S.mix_sources(df.repartition(n), {"a": 0.5, "b": 0.5}, 40, 3).collect())) for n in (1, 6)]
    assert picks[0] == picks[1]
    per = {s: [r for r in picks[0] if r[1] == s] for s in "abc"}
    assert len(per["a"]) == 20 and len({r[0] for r in per["a"]}) == 20 and not per["c"]
    assert len(per["b"]) == 20 and {sum(r[0] == f"b{i}" for r in per["b"]) for i in range(7)} == {2, 3}


def test_shards_cover_every_block_once(spark):
    blocks = spark.range(24).select(F.col("id").alias("block"))
    where = blocks.select("block", *[c.alias(n) for n, c in S.shard_number(F.col("block"), 2, 3).items()])
    assert where.groupBy("rank", "worker").count().filter("count = 4").count() == 6
    assert S.starved_shards(blocks, "block", 2, 3).count() == 0
    assert S.starved_shards(blocks.limit(2), "block", 2, 3).count() == 4


def test_shuffle_does_not_depend_on_layout(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("record_id"))
    a, b = ([r.record_id for r in S.shuffled(df.repartition(n), 5).collect()] for n in (1, 7))
    assert a == b != [str(i) for i in range(100)]
