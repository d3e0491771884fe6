"""Writers: canonical tables, filtered copies, cohorts, analytics and audits.

Every table is written to a staging folder and published after its row counts
agree; a failing stage publishes nothing. Outputs that belong together are
published together (`sources/publish.py`), each with its manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.functions.vectors import is_valid_vector
from peakloom.operators.clean import CleaningPolicy, audit, failed_reasons, reason_counts, removals_of_audit
from peakloom.schema import CANONICAL, SCHEMA_VERSION
from peakloom.session import cut_lineage
from peakloom.sources import manifest as M
from peakloom.sources.publish import Move, publish, recover


def _stage(df: DataFrame, target: str, overwrite: bool, rows_per_file: int | None = None, partition_by=()) -> tuple[str, int]:
    """Write beside the target; the folder and its rows.

    Rows are counted as they are written and again in the footers of the files;
    a difference fails the stage. Only the successful attempt of a task counts.
    """
    spark, seen = df.sparkSession, Observation()
    _ready(spark, target, overwrite)
    staging = target.rstrip("/") + ".staging"
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(staging)
    written, computed = _rows(spark, staging), seen.get["rows"]
    if written != computed:
        raise RuntimeError(f"{computed} rows were computed for {target}, and {written} are in its files")
    return staging, written


def _ready(spark: SparkSession, target: str, overwrite: bool) -> None:
    """Finish what an earlier writer of the target left undone, and refuse to replace it unasked."""
    recover(spark, target)
    if M.exists(spark, target) and not overwrite:
        raise FileExistsError(target)


def _rows(spark: SparkSession, path: str) -> int:
    """Rows of the files, from their footers: no column is read."""
    return spark.read.parquet(path).count()


def write_canonical(df: DataFrame, target: str, source: str, converter: str, toolkit_version: str | None = None,
                    rows_per_file: int | None = None, overwrite: bool = False) -> int:
    """Write a canonical table and its manifest; returns the row count."""
    spark = df.sparkSession
    staging, n = _stage(df.to(CANONICAL), target, overwrite, rows_per_file)
    publish(spark, [Move(staging, target, {
        "canonical_schema_version": SCHEMA_VERSION, "source_dataset": source,
        "converter": converter, "toolkit_version": toolkit_version, "rows": n,
    })])
    return n


def write_filtered(df: DataFrame, ids: DataFrame, target: str, keep: bool, step: str, inputs: list[str],
                   earlier: dict | None = None, overwrite: bool = False) -> int:
    """Copy the rows whose record ID is (or is not) listed, with lineage."""
    spark = df.sparkSession
    kept = df.join(ids.select("record_id").distinct(), "record_id", "left_semi" if keep else "left_anti")
    staging, n = _stage(kept.select(*df.columns), target, overwrite)
    publish(spark, [Move(staging, target, M.extended(earlier or {}, step, inputs, {"output_records": n}))])
    return n


def write_cleaned(records: DataFrame, cleaned: str, removed: str, inputs: list[str],
                  policy: CleaningPolicy = CleaningPolicy(), earlier: dict | None = None,
                  overwrite: bool = False) -> dict:
    """Write the cleaned table and the removal audit, or neither.

    The compact audit columns are computed once and kept in the shared scratch
    folder; the cleaned copy is then one anti join against the removals.
    """
    spark = records.sparkSession
    audited = cut_lineage(audit(records, policy))
    removed_staging, n_removed = _stage(removals_of_audit(audited), removed, overwrite)
    removals = spark.read.parquet(removed_staging)
    # the filter is repeated rather than joined: only duplicates need a join
    kept = (
        records.filter(failed_reasons(policy).isNull())
        .join(removals.filter("duplicate_of is not null").select("record_id"), "record_id", "left_anti")
        .select(*records.columns)
    )
    cleaned_staging, n_kept = _stage(kept, cleaned, overwrite)
    counts = {"input_records": audited.count(), "output_records": n_kept, "removed_records": n_removed}
    if counts["input_records"] != counts["output_records"] + counts["removed_records"]:
        raise RuntimeError(f"the row counts do not add up: {counts}")
    reasons = {r["reason"]: r["records"] for r in reason_counts(removals).collect()}
    lineage = M.extended(earlier or {}, "clean", inputs, counts, reasons=reasons)
    publish(spark, [Move(removed_staging, removed, lineage), Move(cleaned_staging, cleaned, lineage)])
    return {**counts, "reasons": reasons}


def write_cohorts(expanded: DataFrame, records: DataFrame, labels_target: str, records_target: str,
                  overwrite: bool = False) -> int:
    """Label CSVs and record tables per endpoint and split, with equal row counts."""
    spark = expanded.sparkSession
    parts = ["endpoint", "split"]
    labelled = records.join(expanded.select("record_id", *parts), "record_id")
    staging, n = _stage(labelled, records_target, overwrite, partition_by=parts)
    _ready(spark, labels_target, overwrite)
    label_staging = labels_target.rstrip("/") + ".staging"
    expanded.write.mode("overwrite").partitionBy(*parts).csv(label_staging, header=True)
    found = {k: spark.read.format(f).options(header="true").load(p).groupBy(*parts).count()
             for k, f, p in (("records", "parquet", staging), ("labels", "csv", label_staging))}
    unequal = found["records"].withColumnRenamed("count", "a").join(
        found["labels"].withColumnRenamed("count", "b"), parts, "full_outer").filter("not (a <=> b)")
    if unequal.limit(1).count():
        raise RuntimeError("label and record counts differ in a cohort")
    publish(spark, [Move(staging, records_target), Move(label_staging, labels_target)])
    return n


def write_aligned_splits(records: DataFrame, sidecar: DataFrame, assignment: DataFrame, target: str,
                         sidecar_target: str, key: str = "record_id", overwrite: bool = False) -> dict:
    """Records and side table split by the same assignment of a key."""
    spark = records.sparkSession
    staged, counts = [], {}
    for df, goal in ((records, target), (sidecar, sidecar_target)):
        tagged = df.join(assignment.select(key, "split"), key).select(*df.columns, "split")
        staged.append((_stage(tagged, goal, overwrite, partition_by=["split"])[0], goal))
    for staging, goal in staged:
        rows = spark.read.parquet(staging).groupBy("split").count().collect()
        counts[goal] = {r["split"]: r["count"] for r in rows}
    if counts[target] != counts[sidecar_target]:
        raise RuntimeError(f"records and side table differ after the split: {counts}")
    publish(spark, [Move(staging, goal) for staging, goal in staged])
    return counts[target]


def eight_decimals(df: DataFrame) -> DataFrame:
    """Doubles as text with eight decimals; null stays null."""
    def shown(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(F.col(f.name).isNotNull(), F.format_string("%.8f", F.col(f.name).cast("double"))).alias(f.name)
        return F.col(f.name)

    return df.select(*[shown(f) for f in df.schema.fields])


def write_analytics_csv(df: DataFrame, target: str, overwrite: bool = False) -> None:
    eight_decimals(df).write.mode("overwrite" if overwrite else "errorifexists").csv(target, header=True, emptyValue="")


def write_rejections(rejected: DataFrame, target: str, overwrite: bool = False) -> None:
    rejected.write.mode("overwrite" if overwrite else "errorifexists").json(target)


def write_embeddings(embedded: DataFrame, target: str, dimension: int, metadata: dict, rejected: int = 0,
                     overwrite: bool = False) -> int:
    """An embedding cache of one fixed dimension with its metadata.

    A null vector, another length, a component that is null or not finite, or
    only zeros fail the job.
    """
    spark = embedded.sparkSession
    wrong = F.raise_error(F.concat(F.lit("unusable vector of "), F.coalesce("record_id", F.lit("<null>")))).cast("boolean")
    sound = F.coalesce(is_valid_vector(F.col("embedding"), dimension), F.lit(False))
    checked = embedded.filter(F.when(sound, True).otherwise(wrong))
    vectors = checked.select("record_id", F.col("embedding").cast("array<float>").alias("embedding"))
    staging, n = _stage(vectors, target, overwrite)
    publish(spark, [Move(staging, target, {
        **metadata, "dimension": dimension, "accepted_records": n, "rejected_records": rejected})])
    return n


def checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SHA-256 and size of report-sized files (metric tables, manifests)."""
    return spark.read.format("binaryFile").load(paths).select(
        "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
