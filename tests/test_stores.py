"""Bucketed tables, the maintained identity index, and sketches beside tables."""

import os

import pytest
from pyspark.sql import functions as F

from peakloom.operators import overlap, sketches
from peakloom.operators.align import common_records
from peakloom.sources import buckets, index_store
from peakloom.sources import manifest as M


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bucketed_join_moves_nothing(spark, tmp_path, no_broadcast):
    tables = []
    for i in range(3):
        df = spark.range(0, 3000, i + 1).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("record_id"), F.col("id").alias(f"v{i}"))
        assert buckets.write_bucketed(df, f"{tmp_path}/t{i}", "record_id", 6) == len(range(0, 3000, i + 1))
        tables.append((buckets.read_bucketed(spark, f"{tmp_path}/t{i}"), df))
    joined = tables[0][0].join(tables[1][0], "record_id").join(tables[2][0], "record_id")
    plain = tables[0][1].join(tables[1][1], "record_id").join(tables[2][1], "record_id")
    assert joined.exceptAll(plain).count() == 0 and joined.count() == plain.count() == 500
    assert "Exchange" not in plan_of(joined) and "Exchange" in plan_of(plain)
    assert "Exchange" not in plan_of(tables[0][0].groupBy("record_id").count())
    assert common_records({f"r{i}": t.select("record_id") for i, (t, _) in enumerate(tables)}).count() == 500


def test_bucketed_table_is_replaced_whole(spark, tmp_path):
    target = f"{tmp_path}/t"
    schema = "record_id string, `a b` int, m array<struct<x: double>>"
    buckets.write_bucketed(spark.createDataFrame([("a", 1, [(1.0,)]), (None, None, None)], schema), target, "record_id", 4)
    assert sorted(map(repr, buckets.read_bucketed(spark, target).collect()))[0].startswith("Row(record_id='a', a b=1")
    with pytest.raises(FileExistsError):
        buckets.write_bucketed(spark.createDataFrame([], schema), target, "record_id", 4)
    assert buckets.write_bucketed(spark.createDataFrame([], schema), target, "record_id", 2, overwrite=True) == 0
    assert buckets.read_bucketed(spark, target).count() == 0


def records_of(spark, rows):
    return spark.createDataFrame(rows, "key string, text string, row_no long")


def files(target):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(target) for f in names if f.endswith(".parquet")}


def test_two_batches_equal_the_full_index(spark, tmp_path):
    one = [(f"K{i % 40}-x", f"t{i}", i) for i in range(200)] + [(None, "none", 999)]
    two = [("K3-x", "earlier", -5), ("K3-x", "later", 500), ("new-a", "n", 501), (None, "none", 1000)]
    target = f"{tmp_path}/index"
    assert index_store.write_index(records_of(spark, one), target, "key", "text", "row_no", parts=16) == 40
    before = files(target)
    counts = index_store.merge_index(records_of(spark, two), target, "text", "row_no", "second")
    assert counts["keys"] == 41 and counts["batch_keys"] == 2 and 1 <= counts["touched_parts"] <= 2
    after = files(target)
    kept = [f for f in before if f in after]
    assert all(before[f] == after[f] for f in kept) and len(kept) >= len(before) - 2
    full = overlap.identity_index(records_of(spark, one + two), "key", "text", "row_no")
    merged = index_store.read_index(spark, target).select(*full.columns)
    assert merged.exceptAll(full).count() == 0 and merged.count() == full.count()
    assert [s["inputs"] for s in M.read_manifest(spark, target)["lineage"]] == [["first"], ["second"]]
    with pytest.raises(ValueError, match="second"):
        index_store.merge_index(records_of(spark, two), target, "text", "row_no", "second")


def test_a_broken_merge_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    target = f"{tmp_path}/index"
    index_store.write_index(records_of(spark, [("a-1", "x", 1)]), target, "key", "text", "row_no", parts=4)
    real = index_store.finish_merge
    calls = []

    def broken(spark, target):  # the second call would put the folders in place
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError
        return real(spark, target)

    monkeypatch.setattr(index_store, "finish_merge", broken)
    with pytest.raises(RuntimeError):
        index_store.merge_index(records_of(spark, [("a-1", "y", 2)]), target, "text", "row_no", "b")
    monkeypatch.setattr(index_store, "finish_merge", real)
    with pytest.raises(ValueError, match="b is in"):
        index_store.merge_index(records_of(spark, [("a-1", "y", 2)]), target, "text", "row_no", "b")
    assert [(r.key, r.representative, r.record_count) for r in index_store.read_index(spark, target).collect()] == [("a-1", "x", 2)]


def test_sketches_of_parts_give_unions_and_overlaps(spark):
    rows = spark.range(90_000).select((F.col("id") % 3).cast("int").alias("part"), F.floor(F.col("id") / 2).cast("string").alias("key"))
    rows = rows.unionAll(spark.createDataFrame([(0, None), (0, ""), (7, None)], "part int, key string"))
    found = sketches.key_sketches(rows, "part", "key")
    exact = {p: {r.key for r in rows.filter(f"part = {p} and key <> ''").select("key").distinct().collect()} for p in (0, 1, 2)}
    estimate = sketches.union_estimate(found).first()[0]
    assert abs(estimate - 45_000) <= 5 * 1.04 / 128 * 45_000 + 1
    for r in sketches.overlap_estimates(found, "part", [(0, 1), (1, 2), (0, 7)]).collect():
        true = len(exact[r.left] & exact.get(r.right, set()))
        assert abs(r.estimate - true) <= r.bound and r.bound < 6000
    two = sketches.merged(found, F.when(F.col("part") < 2, 0).otherwise(F.col("part")), "part")
    assert {r.part for r in two.collect()} == {0, 2, 7}
    small = sketches.key_sketches(rows.limit(300), "part", "key")
    r = sketches.overlap_estimates(small, "part", [(0, 1)]).first()
    assert r.bound == 1.0 and r.estimate == float(int(r.estimate))


def test_matched_keys_with_and_without_the_bitmap(spark):
    large = spark.range(50_000).select(F.col("id").cast("string").alias("k"))
    few = spark.createDataFrame([(str(i * 7),) for i in range(500)] + [(None,), ("",), ("x",)], "k string")
    plain, fast = (overlap.matched_keys(large, few, "k", prefilter=p) for p in (False, True))
    assert plain.exceptAll(fast).count() == 0 and fast.count() == plain.count() == 500
    passed = overlap.near_keys([large], few, "k")[0].count()
    assert 500 <= passed <= 500 * 1.02 + 0.02 * 50_000
