"""Conformance of landing files in batches."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_batches_are_not_kept_in_memory(spark, monkeypatch):
    def kept(self, *level):
        raise AssertionError("a batch was kept in memory")

    monkeypatch.setattr(type(spark.range(1)), "persist", kept)
    rows = entry.queries()["incremental_conformance"](spark, SF)
    orders = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderkey % 6 <> 0").count()
    assert rows.count() == rows.select("record_id").distinct().count() == orders
