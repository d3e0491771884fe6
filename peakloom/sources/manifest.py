"""Small JSON manifests and reports that travel with a table.

Spark has no arbitrary Parquet footers, so provenance sits in one JSON file
next to the table directory. Files are reached through the Hadoop file system,
so any URI the cluster reads will do.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

MANIFEST_SUFFIX = ".manifest.json"


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, uri: str) -> bool:
    fs, path = _path(spark, uri)
    return fs.exists(path)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, path = _path(spark, source)
    if not fs.rename(path, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not publish {target}")


def delete(spark: SparkSession, uri: str) -> None:
    """Remove a file or folder, if there is one."""
    fs, path = _path(spark, uri)
    if fs.exists(path):
        fs.delete(path, True)


def make_parent(spark: SparkSession, uri: str) -> None:
    fs, path = _path(spark, uri)
    fs.mkdirs(path.getParent())


def write_text(spark: SparkSession, uri: str, text: str, overwrite: bool = False) -> None:
    """Write beside the target and publish by rename."""
    fs, path = _path(spark, uri)
    if fs.exists(path) and not overwrite:
        raise FileExistsError(uri)
    staging = path.suffix(".staging")
    out = fs.create(staging, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(path):
        fs.delete(path, False)
    if not fs.rename(staging, path):
        raise OSError(f"could not publish {uri}")


def read_text(spark: SparkSession, uri: str) -> str:
    rows = spark.read.text(uri, wholetext=True).collect()
    return rows[0][0] if rows else ""


def manifest_uri(table: str) -> str:
    return table.rstrip("/") + MANIFEST_SUFFIX


def write_manifest(spark: SparkSession, table: str, entries: dict, overwrite: bool = False) -> None:
    write_text(spark, manifest_uri(table), json.dumps(entries, indent=2, sort_keys=True) + "\n", overwrite)


def read_manifest(spark: SparkSession, table: str) -> dict:
    uri = manifest_uri(table)
    if not exists(spark, uri):
        raise FileNotFoundError(uri)
    return json.loads(read_text(spark, uri))


def extended(earlier: dict, step: str, inputs: list[str], counts: dict, **details) -> dict:
    """Lineage of a derived table: earlier entries kept, this step appended."""
    history = [*earlier.get("lineage", []), {"step": step, "inputs": inputs, "counts": counts, **details}]
    return {**earlier, "lineage": history}


def stage_report(stage: str, inputs: dict, outputs: dict, counts: dict, details: dict | None = None) -> dict:
    return {"stage": stage, "inputs": inputs, "outputs": outputs, "counts": counts, "details": details or {}}


def write_report(spark: SparkSession, uri: str, report: dict, overwrite: bool = False) -> None:
    if not uri.endswith(".json"):
        raise ValueError(f"a report must be a .json file: {uri}")
    taken = {str(v) for part in ("inputs", "outputs") for v in report.get(part, {}).values()}
    if uri in taken:
        raise ValueError("a report must not replace an input or output")
    write_text(spark, uri, json.dumps(report, indent=2, sort_keys=True) + "\n", overwrite)
