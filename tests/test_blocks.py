"""Blocks of the pair queries against their SQL's rule, for tables of any size."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from peakloom.operators import pairs as P


def test_block_queries_do_not_change_with_the_number_of_rows(spark, monkeypatch):
    seen = []
    for size in (P.BUCKET_ROWS, 4):
        monkeypatch.setattr(P, "BUCKET_ROWS", size)
        seen.append(sorted(map(tuple, entry.queries()["blocks"](spark, "/root/testdata/sf0.01").collect())))
    assert seen[0] == seen[1] and len(seen[0]) > 64


def test_finer_sorting_keeps_columns_and_rows_without_an_id(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") > 1, F.col("id")).alias("record_id"), F.col("id").alias("v"))
    coarse = P.with_blocks(rows, "record_id", 8, 1, digits=1)
    monkeypatch.setattr(P, "BUCKET_ROWS", 5)
    fine = P.with_blocks(rows, "record_id", 8, 1, digits=1)
    assert coarse.columns == fine.columns
    wanted = [sorted(map(tuple, x.filter("record_id is not null").collect())) for x in (coarse, fine)]
    assert wanted[0] == wanted[1] and fine.count() == 3000
