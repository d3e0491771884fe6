import pytest
from pyspark.sql import functions as F

from peakloom.operators import cohort as C
from peakloom.operators import overlap as O


def table(spark, rows):
    return spark.createDataFrame(rows, "record_id string, key string")


def ids(df):
    return sorted(r.record_id for r in df.collect())


def test_overlap_removal_and_attribution(spark):
    bench = table(spark, [("a", "CC"), ("b", "CC"), ("c", "CCC"), ("d", "stereo-a"), ("e", "N"), ("f", None), ("g", "")])
    first, second = table(spark, [("x", "CC"), ("z", None), ("zz", "")]), table(spark, [("y", "CCC"), ("w", "stereo-b"), ("v", "CC")])
    assert ids(O.decontaminate(bench, [first, second], "key")) == ["d", "e", "f", "g"]
    found = {r.comparison: r.new_molecules for r in O.attribution(bench, {"1": first, "2": second, "3": second}, "key").collect()}
    assert found == {"1": 1, "2": 1, "3": 0}
    assert O.decontamination_counts(bench, [first, second], "key").first().asDict() == {
        "input_records": 7, "output_records": 4, "removed_records": 3, "removed_molecules": 2}


def test_transfer(spark):
    bench = table(spark, [("keep", "N"), ("move-a", "CCC"), ("move-b", "CCC")])
    remaining, train, moved = O.transfer(bench, table(spark, [("r", "CCC")]), table(spark, [("base", "O")]), "key")
    assert ids(remaining) == ["keep"] and ids(train) == ["base", "move-a", "move-b"]
    assert O.transfer_conflicts(moved, table(spark, [("move-a", "x")])).collect() == [("move-a",)]
    assert O.transfer_conflicts(moved, table(spark, [("base", "O")])).count() == 0


def test_merge_keeps_input_positions(spark):
    merged = O.merge_tables([table(spark, [("a", "x"), ("b", "x")]), table(spark, [("c", "x")])])
    assert [(r.record_id, r.input_order) for r in merged.orderBy("input_order", "record_id").collect()] == [("a", 0), ("b", 0), ("c", 1)]
    with pytest.raises(ValueError):
        O.merge_tables([table(spark, [("a", "x")]), spark.range(1)])


def test_overlap_audit_with_connectivity(spark):
    index = O.identity_index(spark.createDataFrame(
        [("A-1", "t1", 1), ("A-1", "t0", 0), ("B-1", "t2", 2)], "key string, text string, row_no long"), "key", "text", "row_no")
    assert {r.key: (r.record_count, r.representative) for r in index.collect()} == {"A-1": (2, "t0"), "B-1": (1, "t2")}
    props = spark.createDataFrame([("r", "A-1"), ("r", "A-2"), ("r", "B-2"), ("r", "C-1"), ("r", None), ("r", "A-1"), ("empty", None)],
                                  "release string, key string")
    found = {r.release: r for r in O.overlap_audit(props, index, "release", "key").collect()}
    r = found["r"].asDict()
    assert (r["unique_molecules"], r["exact_overlap"], r["exact_overlap_percent"], r["matched_records"]) == (4, 1, 25.0, 2)
    assert (r["connectivity_overlap"], r["connectivity_only"], r["rows_beyond_unique"]) == (2, 1, 1)
    assert found["empty"].exact_overlap_percent == 0.0 and found["empty"].unique_molecules == 0


LABELS = "endpoint string, split string, key string, label string, row_no long"


def test_label_consolidation(spark):
    labels = spark.createDataFrame([
        ("e", "train_val", "k1", "1.00", 1), ("e", "train_val", "k1", "1.0", 0),
        ("e", "train_val", "k2", "2.0", 2), ("e", "train_val", "k2", "3.0", 3)], LABELS)
    records = table(spark, [("r1", "k1"), ("r2", "k1"), ("r3", "k2"), ("r4", "other")])
    merged = C.consolidate(labels)
    rows = C.expand(merged, records).collect()
    assert sorted((r.record_id, r.label) for r in rows) == [("r1", "1.0"), ("r2", "1.0")]
    s = C.release_statistics(merged, records).first()
    assert (s.matched_property_rows, s.matched_records, s.output_records, s.agreeing_duplicates, s.discordant_molecules) == (4, 3, 2, 1, 1)
    assert ids(C.training_pool(records, labels)) == ["r4"]


@pytest.mark.parametrize("label", ["x", "nan", "inf", None])
def test_unreadable_labels_fail(spark, label):
    labels = spark.createDataFrame([("e", "test", "k", label, 0)], LABELS)
    with pytest.raises(Exception, match="invalid label for k"):
        C.consolidate(labels).collect()


def test_cross_split_keys_leave_both_splits(spark):
    labels = spark.createDataFrame([
        ("e", "train_val", "CCO", "1", 0), ("e", "test", "CCO", "1", 1), ("e", "test", "CCC", "2", 2),
        ("f", "test", "CCO", "1", 3)], LABELS)
    assert C.cross_split_keys(labels).collect() == [("e", "CCO")]
    assert sorted((r.endpoint, r.key) for r in C.drop_cross_split(labels).collect()) == [("e", "CCC"), ("f", "CCO")]


def test_hot_label_key_is_exact(spark):
    """A third of labels and records share one key."""
    labels = spark.range(900).select(
        F.lit("e").alias("endpoint"), F.lit("test").alias("split"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"),
        F.lit("1").alias("label"), F.col("id").alias("row_no"))
    records = spark.range(300).select(
        F.col("id").cast("string").alias("record_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("k1").alias("key"))
    rows = C.expand(C.consolidate(labels), records)
    assert rows.groupBy("key").count().orderBy("key").collect() == [("hot", 100), ("k1", 200)]
    assert rows.filter("key = 'hot'").select("row_no").distinct().collect() == [(0,)]
