"""Tables stored in buckets of a key, so that joins on the key need no shuffle.

Records, side tables and caches that are written with the same number of buckets
lie side by side: a join reads bucket with bucket. The bucketing is part of the
table's definition in the session catalog; a manifest beside the files keeps it,
so any later session defines the table again from there.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.sources import manifest as M
from peakloom.sources.publish import Move, manifest_of, publish, recover, resolve


def _name(target: str, version: str) -> str:
    return "buckets_" + hashlib.sha256(f"{target.rstrip('/')}:{version}".encode()).hexdigest()[:24]


def write_bucketed(df: DataFrame, target: str, key: str, buckets: int, overwrite: bool = False) -> int:
    """Write a table in sorted buckets of `key`; returns the row count.

    Rows are brought together by bucket first, so every bucket is one file and
    a scan keeps its order.
    """
    spark = df.sparkSession
    recover(spark, target)
    if M.exists(spark, target) and not overwrite:
        raise FileExistsError(target)
    staging = target.rstrip("/") + ".staging"
    M.delete(spark, staging)
    temporary = _name(target, "staging")
    spark.sql(f"DROP TABLE IF EXISTS {temporary}")
    ready = df.repartition(buckets, F.col(key))
    ready.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", staging).saveAsTable(temporary)
    n = spark.table(temporary).count()
    spark.sql(f"DROP TABLE {temporary}")  # the files stay: the table only named their folder
    publish(spark, [Move(staging, target, {"key": key, "buckets": buckets, "rows": n, "schema": json.loads(df.schema.json())})])
    return n


def read_bucketed(spark: SparkSession, target: str) -> DataFrame:
    """The table, with its buckets known to the planner."""
    entries = manifest_of(spark, target)
    folder = resolve(spark, target)
    schema = T.StructType.fromJson(entries["schema"])
    name = _name(folder, json.dumps(entries, sort_keys=True))
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    key = entries["key"].replace("`", "``")
    location = folder.replace("'", "\\'")
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
            f"INTO {entries['buckets']} BUCKETS LOCATION '{location}'")
    else:
        spark.catalog.refreshTable(name)
    return spark.table(name)
