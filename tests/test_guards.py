"""Rows that used to vanish or to be cut without an error."""

import pytest
from pyspark.sql import functions as F

from peakloom.functions import model_inputs as I
from peakloom.operators import align, cohort, metrics, pairs, profile, split
from peakloom.operators.ranking import average_rank
from peakloom.schema import CANONICAL, SIDECAR
from peakloom.sources import readers, writers


def test_padding_refuses_longer_lists(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(I.padded(F.col("v"), 3, F.lit(0.0))).collect()] == [[1.0, 2.0, 0.0], [0.0, 0.0, 0.0]]
    with pytest.raises(Exception, match="2 entries where at most 1"):
        df.select(I.padded(F.col("v"), 1, F.lit(0.0))).collect()


def test_small_couplings_have_no_exponent(spark):
    df = spark.createDataFrame([([0.0001, 0.00025, 7.5, 0.0],)], "v array<double>")
    assert df.select(I.j_text(F.col("v"))).first()[0] == "0.0001_0.00025_7.5_0.0"


def test_null_keys_fail_and_null_groups_stay(spark):
    keys = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "k string")
    with pytest.raises(Exception, match="no key or score"):
        cohort.fraction_split(keys, "k", 0.5, seed=1).collect()
    rows = spark.createDataFrame([("g", 1, 0.5), ("g", 0, 0.25), (None, 1, 0.5), (None, 0, 0.75)], "g string, y int, s double")
    found = {r.g: (r.support, r.roc_auc) for r in metrics.ranking_metrics(rows, "y", "s", ("g",)).collect()}
    assert found == {"g": (2, 1.0), None: (2, 0.0)}
    with pytest.raises(Exception, match="no score"):
        metrics.ranking_metrics(rows.unionAll(spark.sql("select 'g', 1, cast(null as double)")), "y", "s", ("g",)).collect()


def test_a_missing_score_has_no_rank(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", None), ("c", 3.0), ("d", 1.0)], "m string, v double").withColumn("g", F.lit(1))
    assert dict(rows.select("m", average_rank(["g"], "v")).collect()) == {"a": 1.5, "b": None, "c": 1.5, "d": 3.0}


def test_mixture_quotas_add_up_and_absent_sources_fail(spark):
    rows = spark.createDataFrame([(f"{s}{i}", s) for s in "abc" for i in range(20)], "record_id string, source string")
    mixed = split.mix_sources(rows, {"a": 1, "b": 1, "c": 1}, 100, 7)
    assert sorted(r["count"] for r in mixed.groupBy("source").count().collect()) == [33, 33, 34]
    with pytest.raises(Exception, match="no rows of source z"):
        split.mix_sources(rows, {"a": 1, "z": 1}, 10, 7).collect()


def test_pairs_on_the_real_schemas_and_stable_descriptors(spark):
    paired = align.usable_pairs(spark.createDataFrame([], CANONICAL), spark.createDataFrame([], SIDECAR))
    assert paired.select("smiles_canonical").count() == 0 and len(set(paired.columns)) == len(paired.columns)
    left = spark.createDataFrame([("a",), ("b",)], "record_id string")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y")], "record_id string, n int, t string").repartition(2)
    assert sorted(map(tuple, align.with_descriptors(left, right).collect())) == [("a", 1, "y"), ("b", None, None)]


@pytest.mark.parametrize("vector", [None, [float("nan"), 1.0], [0.0, 0.0], [1.0], [1.0, None]])
def test_unsound_embeddings_are_refused(spark, tmp_path, vector):
    rows = spark.createDataFrame([("good", [1.0, 2.0]), ("bad", vector)], "record_id string, embedding array<double>")
    with pytest.raises(Exception, match="unusable vector of bad"):
        writers.write_embeddings(rows, str(tmp_path / "e"), 2, {})


def test_first_lines_are_the_first_of_the_file(spark, tmp_path):
    import json

    path = tmp_path / "many.jsonl"
    path.write_text("".join(json.dumps({"record_id": f"r{i:05d}"}) + "\n\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [r.record_id for r in readers.read_any(spark, str(path), 700).select("record_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == [f"r{i:05d}" for i in range(700)]


def test_samples_take_the_first_rows_for_any_size(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), "id")
    got = [r.id for r in profile.sample_per_group(rows, "g", 1500, ["id"]).filter("g = 1").collect()]
    assert sorted(got) == list(range(1, 3000, 2))


def test_blocks_get_more_buckets_with_more_rows(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BUCKET_ROWS", 10)
    blocked = pairs.with_blocks(spark.range(1000).select(F.col("id").alias("record_id")), "record_id", 4, 1)
    first = {r.block_id.split("-")[0] for r in blocked.collect()}
    assert {len(f) for f in first} == {2} and blocked.groupBy("block_id").count().agg(F.max("count")).first()[0] <= 4
