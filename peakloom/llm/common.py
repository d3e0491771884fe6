"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.session import scratch_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read back.

    Later jobs read the files, so a lost executor costs a re-read and the
    rows cannot differ between two uses.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


#: Bytes of text that a labelled sample may have.
SAMPLE_BYTES = 64 << 20


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, trainable: Column, per_class: int, max_bytes: int = SAMPLE_BYTES
) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of a bounded sample, and the share of label 1 among all trainable labels.

    Of each class at most `per_class` labelled IDs that have a text are chosen
    by a hash of doc_id. Their texts are taken whole, long ones too, in the
    order of that hash while they have at most `max_bytes` together; the first
    of each class is taken in any case. The chosen IDs (at most twice
    `per_class`) are broadcast, so documents do not move.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & trainable).select(
        "doc_id", F.col(label).cast("int").alias("label")
    )
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    written = docs.filter(F.col("text").isNotNull())
    usable = known.join(written.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [usable.filter(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    rows = (
        written.select("doc_id", "text").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
        .orderBy(*order, "label", "text").limit(2 * per_class)
    )
    before = Window.orderBy(*order, "label", "text").rowsBetween(Window.unboundedPreceding, 0)
    of_class = Window.partitionBy("label").orderBy(*order, "text")
    sized = rows.withColumn("total", F.sum(F.octet_length("text")).over(before)).withColumn("place", F.row_number().over(of_class))
    sample = sized.filter((F.col("total") <= max_bytes) | (F.col("place") == 1)).orderBy(*order, "label", "text")
    found = sample.select("text", "label").collect()
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return [r["text"] for r in found], np.array([r["label"] for r in found], dtype=np.int64), share


def category_ranges(category: str) -> str:
    """The characters below U+10000 of a general category, such as L, as ranges for a pattern's set."""
    inside = groupby(range(0x10000), lambda c: unicodedata.category(chr(c)).startswith(category))
    runs = [list(codes) for found, codes in inside if found]
    return "".join(f"\\u{run[0]:04x}-\\u{run[-1]:04x}" for run in runs)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


#: The session's limit for an Arrow batch, and the bytes that a batch of texts has by `bound_batches`.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Send rows to Python workers in batches of about BATCH_BYTES, unless the session has a limit of its own.

    Spark's 10,000 rows are tens of megabytes of text, which the JVM and each
    worker hold in several copies and hardly give back. The limit stays set,
    as a plan is only made when its rows are wanted. A longer text goes into a
    batch whole; results do not depend on batches.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


#: Texts of a batch that are Python objects at the same time.
FEW = 256


def by_slices(column: pa.Array, compute: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """`compute` of a few rows at a time, so that a worker never holds a whole batch as Python objects."""
    parts = [compute(column.slice(begin, FEW)) for begin in range(0, max(1, len(column)), FEW)]
    pa.default_memory_pool().release_unused()  # workers live on between tasks and stages
    return pa.concat_arrays(parts)


def list_array(values: np.ndarray | pa.Array, lengths: Sequence[int] | np.ndarray) -> pa.Array:
    """An Arrow list column from its flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


#: Texts that are cut and encoded together.
TOGETHER = 1024


def encode_runs(texts: Sequence[str | None], run_ids: Callable[[str], bytes]) -> list[np.ndarray]:
    """IDs of each text, put together from the IDs of what stands between its spaces.

    `run_ids` gives the little-endian 32-bit IDs of one run. It is asked once
    per distinct run of these texts; the IDs are then gathered for all runs at
    once. A null text has no runs, an empty one has one empty run.
    """
    lists = pc.split_pattern(pa.array(texts, type=pa.large_string()), " ")
    coded = lists.flatten().dictionary_encode()
    known = list(map(run_ids, coded.dictionary.to_pylist()))
    size = np.fromiter(map(len, known), np.int64, len(known)) // 4
    codes = coded.indices.to_numpy()
    n = size[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat((np.cumsum(size) - size)[codes] - ends[:-1], n) + np.arange(ends[-1])
    ids = np.frombuffer(b"".join(known), "<u4")[at]
    runs = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.split(ids, ends[np.cumsum(runs)][:-1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


class WordCache(dict):
    """Values per word, computed on first use, in two generations of bounded size.

    A full young generation becomes the old one; words still in use move back
    on their next look-up.
    """

    def __init__(self, compute, size: int = 250_000):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value
