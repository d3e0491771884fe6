"""Contiguous shards of nearly equal bytes, by global prefix sums.

Rows are sorted by key over ordered partitions; only key, size and checksum
move. Each partition sums its own rows, the totals of the partitions (one row
each) give every partition its offset, and a row's shard follows from where the
middle of its bytes lies between 0 and the grand total. Targets are equal, so
no shard is off by more than its two boundary rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.llm.common import staged

ROW_BYTES = 16
LOCAL = "doc_id long, size long, text_crc32 long, part int, before long, at long"


def byte_shards(
    docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", row_bytes: int = ROW_BYTES
) -> DataFrame:
    """`doc_id, size, text_crc32, shard, slot`: shards 0 to `shards - 1` in key order.

    Size is the UTF-8 length of the text (null: none) plus `row_bytes`; the
    checksum of a null text is that of the empty one. Rows are ordered by key
    (null first), then checksum and size; rows equal in all three take
    consecutive slots. `slot` counts the rows of a shard from 0. An empty table
    gives no rows; with fewer rows than shards some shards stay empty.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), (F.octet_length(data) + row_bytes).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    ordered = rows.repartitionByRange("doc_id", "text_crc32").sortWithinPartitions("doc_id", "text_crc32", "size")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, at = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(before + np.cumsum(sizes) - sizes),
                 pa.array(np.arange(at, at + n))],
                ["doc_id", "size", "text_crc32", "part", "before", "at"],
            )
            before, at = before + int(sizes.sum()), at + n

    local = staged(ordered.mapInArrow(running, LOCAL), "shard-sizes")
    # a part spans few shards, so the offsets below have about one row per part and shard
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = local.groupBy("part").agg(F.sum("size").alias("bytes"))
    offsets = totals.select(
        "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("bytes").over(Window.partitionBy()).alias("_total"),
    )
    # twice the middle of the row's bytes, in whole numbers
    middle = 2 * (F.col("_offset") + F.col("before")) + F.col("size")
    placed = local.join(F.broadcast(offsets), "part").withColumn(
        "shard", F.least(F.floor(middle * shards / (2 * F.col("_total"))), F.lit(shards - 1)).cast("int")
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"), F.min("at").alias("_first"))
    in_shard = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "part", "_first", F.coalesce(F.sum("rows").over(in_shard), F.lit(0)).alias("_start")
    )
    return placed.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("at") - F.col("_first")).alias("slot")
    )
