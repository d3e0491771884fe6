"""Conform landing files as they arrive, in bounded batches.

The conform and validation operators are narrow projections, so they run
unchanged on a streaming DataFrame. Each micro-batch appends accepted rows to
the canonical table and rejected rows to the rejection log; the checkpoint
makes a restarted run continue where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from peakloom.operators.conform import route


def conform_new_files(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    conform: Callable[[DataFrame], DataFrame],
    accepted_path: str,
    rejected_path: str,
    checkpoint: str,
    files_per_batch: int = 64,
) -> None:
    """Process every landing file not seen before, then stop."""
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(landing)
    )

    def write(batch: DataFrame, epoch: int) -> None:
        # both outputs read the files; kept in memory, a file's rows would be one block many times its size
        accepted, rejected = route(batch)
        # a folder per batch: a repeated batch replaces its own output
        accepted.write.mode("overwrite").option("compression", "zstd").parquet(f"{accepted_path}/batch={epoch}")
        rejected.write.mode("overwrite").json(f"{rejected_path}/batch={epoch}")

    query = (
        conform(stream)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
