"""Text functions hold few rows of a batch as Python objects."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from peakloom.llm import common, near_copies, pii, quality


def test_slices_are_few_and_in_order():
    sizes = []

    def upper(column):
        sizes.append(len(column))
        return pa.array([None if t is None else t.upper() for t in column.to_pylist()], type=pa.string())

    rows = [None if i % 7 == 0 else f"t{i}" for i in range(1000)]
    assert common.by_slices(pa.array(rows), upper).to_pylist() == [t and t.upper() for t in rows]
    assert max(sizes) == common.FEW and sum(sizes) == 1000
    assert common.by_slices(pa.array([], type=pa.string()), upper).to_pylist() == []


MODEL = quality.fit_quality(["good words here and more", "x"], np.array([1, 0]), 0.5, pairs=10, steps=2)


@pytest.mark.parametrize("module, function", [
    (pii, pii.redact), (pii, pii.pii_spans), (near_copies, near_copies.signature), (quality, lambda c: quality.quality_score(c, MODEL))])
def test_functions_work_by_slices(monkeypatch, module, function):
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda work: lambda column: work)
    whole, sizes = common.by_slices, []
    monkeypatch.setattr(module, "by_slices", lambda column, compute: whole(column, lambda part: sizes.append(len(part)) or compute(part)))
    texts = [None if i % 9 == 0 else f"mail a{i}@b.org, word {i} and +49 30 1234567{i % 10}" for i in range(600)]
    work = function(None)
    found = work(pa.array(texts)).to_pylist()
    assert max(sizes) == common.FEW and sum(sizes) == 600
    assert found[300:310] == work(pa.array(texts[300:310])).to_pylist()


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "pii", "bpe"])
def test_stages_bound_the_batches_of_python_workers(spark, stage):
    @F.arrow_udf("struct<rows:long,bytes:long>")
    def batch(column: pa.Array) -> pa.Array:
        n = len(column)
        return pa.StructArray.from_arrays([pa.array([n] * n), pa.array([column.nbytes] * n)], ["rows", "bytes"])

    long_text = F.when(F.col("doc_id") == 77, F.repeat(F.lit("long "), 2_000_000))
    other_text = F.concat(F.col("doc_id").cast("string"), F.repeat(F.lit(" word"), 600))
    docs = spark.range(0, 8000, 1, 1).withColumnRenamed("id", "doc_id").withColumn("text", F.coalesce(long_text, other_text))
    spark.conf.unset(common.BATCH_LIMIT)
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(5), "/root/testdata/sf0.001")
        found = docs.select("doc_id", batch(F.col("text")).alias("b")).select("doc_id", "b.*").collect()
        assert len(found) == 8000 and max(r.rows for r in found) * 3000 < 2 * common.BATCH_BYTES
        assert max(r.bytes for r in found) < 10_000_000 + 2 * common.BATCH_BYTES
        spark.conf.set(common.BATCH_LIMIT, 1 << 20)
        common.bound_batches(spark)
        assert int(spark.conf.get(common.BATCH_LIMIT)) == 1 << 20  # a limit of the session's own stays
    finally:
        spark.conf.unset(common.BATCH_LIMIT)
