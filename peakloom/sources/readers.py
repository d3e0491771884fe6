"""Readers with the guards each table kind needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.functions.text import binary_key_text, optional_text
from peakloom.operators.overlap import union_all
from peakloom.operators.validate import first_invalid_property
from peakloom.schema import CANONICAL, SCHEMA_VERSION, same_shape
from peakloom.sources import manifest as M
from peakloom.sources.publish import manifest_of, resolve

ROW_ORDER = ["input_file", "row_index"]


def read_canonical(spark: SparkSession, path: str, toolkit_version: bool = False) -> DataFrame:
    """A canonical table; refuses another schema, version or missing toolkit version."""
    entries = manifest_of(spark, path)
    if entries.get("canonical_schema_version") != SCHEMA_VERSION:
        raise ValueError(f"{path} is not a version {SCHEMA_VERSION} table")
    if toolkit_version and not entries.get("toolkit_version"):
        raise ValueError(f"{path} does not name its toolkit version")
    found = spark.read.parquet(resolve(spark, path))
    if not same_shape(found.schema, CANONICAL):
        raise ValueError(f"{path} does not have the canonical schema")
    return found


def read_compatible(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """Several canonical tables that were made by one toolkit version."""
    if not paths:
        raise ValueError("no input tables")
    versions = {manifest_of(spark, p).get("toolkit_version") for p in paths}
    if len(versions) != 1:
        raise ValueError(f"the inputs come from different toolkit versions: {sorted(map(str, versions))}")
    return [read_canonical(spark, p, toolkit_version=True) for p in paths]


def with_row_order(df: DataFrame) -> DataFrame:
    """Add the file and the row position inside it (file sources only)."""
    return df.select("*", F.col("_metadata.file_path").alias("input_file"),
                     F.col("_metadata.row_index").alias("row_index"))


def read_records(spark: SparkSession, paths: list[str], ordered: bool = False) -> DataFrame:
    """Records of one or more Parquet tables, reduced to the known fields."""
    parts = []
    for path in paths:
        df = spark.read.parquet(resolve(spark, path))
        if "record_id" not in df.columns:
            raise ValueError(f"{path} has no record_id")
        known = [f.name for f in CANONICAL.fields if f.name in df.columns]
        missing = {
            f.name: F.lit(None).cast(f.dataType) for f in CANONICAL.fields if f.name not in known
        }
        df = with_row_order(df) if ordered else df
        parts.append(df.withColumns(missing).select(*CANONICAL.names, *(ROW_ORDER if ordered else [])))
    return union_all(parts)


#: File, block of the file and line within the block: together the order of the lines.
LINE_ORDER = ("input_file", "block_start", "line_order")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CANONICAL) -> DataFrame:
    """JSON lines; blank lines are skipped. `problem` tells why a line is unreadable."""
    lines = (
        spark.read.text(path)
        .select(
            "value", F.col("_metadata.file_path").alias("input_file"),
            F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("line_order"),
        )
        .filter(F.trim("value") != "")
    )
    parsed = F.from_json(
        "value", T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    is_object = F.startswith(F.ltrim(F.col("value")), F.lit("{"))
    rows = lines.withColumn("_row", parsed)
    problem = F.when(~is_object, "not an object").when(F.col("_row._corrupt").isNotNull(), "invalid JSON")
    return rows.select("_row.*", problem.alias("problem"), F.col("value").alias("line"), *LINE_ORDER).drop("_corrupt")


def readable_jsonl(
    spark: SparkSession, path: str, schema: T.StructType = CANONICAL, ordered: bool = False
) -> DataFrame:
    """JSON lines; the first unreadable line fails the job. `ordered` keeps the columns of LINE_ORDER."""
    rows = read_jsonl(spark, path, schema)
    place = F.concat(F.col("input_file"), F.lit(": "), F.col("problem"), F.lit(": "), F.substring("line", 1, 80))
    stop = F.raise_error(place).cast("boolean")
    return rows.filter(F.when(F.col("problem").isNotNull(), stop).otherwise(True)).drop(
        "problem", "line", *(() if ordered else LINE_ORDER)
    )


def in_memory_records(spark: SparkSession, rows: list, schema: T.StructType = CANONICAL) -> DataFrame:
    """Records given by the caller; record IDs must be unique."""
    df = spark.createDataFrame(rows, schema)
    if df.groupBy("record_id").count().filter("count > 1").limit(1).count():
        raise ValueError("record IDs must be unique")
    return df


def read_any(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """Choose the reader by suffix; optionally the first records in file order."""
    if path.rstrip("/").endswith((".jsonl", ".json")):
        if max_records is None:
            return readable_jsonl(spark, path)
        return readable_jsonl(spark, path, ordered=True).orderBy(*LINE_ORDER).limit(max_records).drop(*LINE_ORDER)
    if max_records is None:
        return read_records(spark, [path])
    return read_records(spark, [path], ordered=True).orderBy(*ROW_ORDER).limit(max_records).drop(*ROW_ORDER)


SPLIT_ALIASES = (("train", ("train",)), ("val", ("val", "valid")), ("test", ("test",)))


def resolve_splits(spark: SparkSession, root: str, suffix: str, prefer_all: bool = False,
                   require_all_splits: bool = False) -> dict[str, str]:
    """Ordered split paths of a dataset directory: train, val or valid, test."""
    root = root.rstrip("/")
    if prefer_all and M.exists(spark, f"{root}/all{suffix}"):
        return {"all": f"{root}/all{suffix}"}
    found = {}
    for split, names in SPLIT_ALIASES:
        for name in names:
            if M.exists(spark, f"{root}/{name}{suffix}"):
                found[split] = f"{root}/{name}{suffix}"
                break
    if not found or (require_all_splits and len(found) < len(SPLIT_ALIASES)):
        raise FileNotFoundError(f"no complete set of split files under {root}")
    return found


def read_splits(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All splits in one table with `split` and `split_order`."""
    return union_all([
        spark.read.parquet(p).withColumns({"split": F.lit(s), "split_order": F.lit(i)})
        for i, (s, p) in enumerate(paths.items())
    ])


def read_property_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A property CSV with all columns as text; a byte order mark is tolerated."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if not df.columns:
        raise ValueError(f"{path} has no header")
    if "record_id" in df.columns:
        raise ValueError(f"{path} must not have a record_id column")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return df


# Column names and class of the workbook export.
WORKBOOK_COLUMNS = ("SMILES", "logP", "Ionisation-based class")
WORKBOOK_CLASS = "P"


def select_workbook_rows(export: DataFrame, key_of=optional_text) -> DataFrame:
    """High-confidence rows of a workbook export as Drug_ID, Drug and Y."""
    text, value, kind = (F.col(f"`{c}`") for c in WORKBOOK_COLUMNS)
    not_blank = F.greatest(*[F.col(f"`{c}`").isNotNull() for c in export.columns])
    return export.filter(not_blank & (kind == WORKBOOK_CLASS)).select(
        key_of(text).alias("Drug_ID"), text.alias("Drug"), value.cast("string").alias("Y")
    ).filter(F.col("Drug_ID").isNotNull())


def workbook_counts(export: DataFrame, key_of=optional_text) -> DataFrame:
    text, _, kind = (F.col(f"`{c}`") for c in WORKBOOK_COLUMNS)
    not_blank = F.greatest(*[F.col(f"`{c}`").isNotNull() for c in export.columns])
    chosen = not_blank & (kind == WORKBOOK_CLASS)
    return export.agg(
        F.count_if(not_blank).alias("source_rows"),
        F.count_if(chosen & key_of(text).isNotNull()).alias("kept_rows"),
        F.count_if(chosen & key_of(text).isNull()).alias("invalid_rows"),
    )


def require_unique(df: DataFrame, column: str, what: str) -> None:
    if df.groupBy(column).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{what} repeats a {column}")


def read_embeddings(spark: SparkSession, path: str, ids_only: bool = False) -> tuple[DataFrame, dict]:
    """An embedding cache and its metadata; record IDs must be unique."""
    metadata = manifest_of(spark, path)
    df = spark.read.parquet(resolve(spark, path)).select("record_id", *([] if ids_only else ["embedding"]))
    require_unique(df, "record_id", path)
    return df, metadata


def read_properties(spark: SparkSession, path: str, fields: list[str], status: str = "rdkit_status") -> DataFrame:
    """Side-table columns; IDs must be unique and every status ok."""
    df = spark.read.parquet(path).select("record_id", "smiles_canonical", status, *fields)
    per_id = df.groupBy("record_id").agg(
        F.count("*").alias("n"),
        F.count_if(first_invalid_property(F.col(status), (), ()).isNotNull()).alias("bad"),
    )
    found = per_id.agg(F.max("n").alias("n"), F.sum("bad").alias("bad")).first()
    if (found["n"] or 0) > 1 or found["bad"]:
        raise ValueError(f"{path} repeats a record ID or has rows that are not ok")
    return df


def read_metric_tables(spark: SparkSession, root: str, file_name: str, required: list[str]) -> DataFrame:
    """All metric CSVs below a directory; the directory names the representation."""
    df = spark.read.csv(f"{root.rstrip('/')}/*/{file_name}", header=True, inferSchema=True)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"the metric tables lack {missing}")
    # the path is percent-encoded, but a plus sign in it is a plus sign
    encoded = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    folder = F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    return df.select("*", folder.alias("representation"))


def read_split_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = "records array<struct<split:string,record_id:string,molecule_id:string,source:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("records"))


def read_cohorts(spark: SparkSession, root: str, endpoints: list[str], splits: list[str], kind: str = "parquet") -> DataFrame:
    """Endpoint by split tables under `root/endpoint/split`, tagged and united."""
    return union_all([
        spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}))
        .load(f"{root.rstrip('/')}/{e}/{s}.{kind}")
        .withColumns({"endpoint": F.lit(e), "split": F.lit(s)})
        for e in endpoints for s in splits
    ])


def landing_keys(landing: DataFrame, key: str = "key") -> DataFrame:
    """Text keys for a landing table of (binary key, payload) rows."""
    return landing.withColumn(key, binary_key_text(F.col(key)))
