"""An identity index on disk that batches are merged into.

The index lies in folders by key hash. A batch is grouped first, and only the
folders that its keys fall into are read, merged and written anew; all others
keep their files. Every merge is added to the lineage in the manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators.overlap import index_rows, merged_index
from peakloom.session import cut_lineage, scratch_path
from peakloom.sources import manifest as M


def write_index(records: DataFrame, target: str, key: str, text: str, row_no: str, parts: int = 64, batch: str = "first") -> int:
    """A new index of the records; returns its number of keys."""
    spark = records.sparkSession
    if M.exists(spark, target):
        raise FileExistsError(target)
    index_rows(records, key, text, row_no, parts).repartition("part").write.partitionBy("part").parquet(target)
    n = spark.read.parquet(target).count()
    M.write_manifest(spark, target, M.extended({"key": key, "parts": parts}, "index", [batch], {"keys": n}), overwrite=True)
    return n


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """`key, connectivity, representative, first_row, record_count`."""
    return spark.read.parquet(target).drop("part")


def merge_index(records: DataFrame, target: str, text: str, row_no: str, batch: str) -> dict:
    """Merge a batch of records into the index; returns the counts of the merge.

    Row numbers must say which record came first over all batches. A batch name
    that the lineage has already is refused, so a repeated run cannot count its
    records twice. The merged folders are written to the scratch folder and
    noted in the manifest before they replace the old ones; a merge that was
    broken off after that is finished by the next one.
    """
    spark = records.sparkSession
    entries = finish_merge(spark, target)
    if any(batch in step["inputs"] for step in entries["lineage"]):
        raise ValueError(f"batch {batch} is in the index")
    key, parts = entries["key"], entries["parts"]
    fresh = cut_lineage(index_rows(records, key, text, row_no, parts))
    touched = sorted(r["part"] for r in fresh.select("part").distinct().collect())  # at most `parts` numbers
    old = spark.read.parquet(target).filter(F.col("part").isin(touched))
    merged = scratch_path(spark, "index-merge")
    merged_index(old, fresh, key, parts).write.parquet(merged)
    merging = {"batch": batch, "merged": merged, "counts": {"batch_keys": fresh.count(), "touched_parts": len(touched)}}
    M.write_manifest(spark, target, {**entries, "merging": merging}, overwrite=True)
    return finish_merge(spark, target)["lineage"][-1]["counts"]


def finish_merge(spark: SparkSession, target: str) -> dict:
    """Put noted merged folders in place, if there are any, and give the manifest. Doing so again changes nothing."""
    entries = M.read_manifest(spark, target)
    merging = entries.pop("merging", None)
    if merging:
        merged = spark.read.parquet(merging["merged"])
        writer = merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("part").parquet(target)
        counts = {**merging["counts"], "keys": spark.read.parquet(target).count()}
        entries = M.extended(entries, "merge", [merging["batch"]], counts)
        M.write_manifest(spark, target, entries, overwrite=True)
    return entries
