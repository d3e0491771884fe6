"""Pair records with side tables, labels and embedding caches by record ID."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.vectors import is_valid_vector
from peakloom.operators.overlap import union_all
from peakloom.schema import MACCS_BITS, MORGAN_BYTES


def presence(records: DataFrame, sidecar: DataFrame, key: str | None = None) -> DataFrame:
    """Per record ID: row counts on both sides and the smallest key of each side."""
    def side(df, name):
        k = F.col(key).cast("string") if key else F.lit(None).cast("string")
        return df.select("record_id", F.lit(name).alias("_side"), k.alias("_key"))

    both = side(records, "r").unionByName(side(sidecar, "s"))
    here, there = F.col("_side") == "r", F.col("_side") == "s"
    return both.groupBy("record_id").agg(
        F.count_if(here).alias("n_records"),
        F.count_if(there).alias("n_sidecar"),
        F.min(F.when(here, F.col("_key"))).alias("record_key"),
        F.min(F.when(there, F.col("_key"))).alias("sidecar_key"),
    )


def alignment_audit(records: DataFrame, sidecar: DataFrame, key: str | None = None) -> DataFrame:
    """Counts that must all be zero before the two tables may be paired."""
    both = (F.col("n_records") > 0) & (F.col("n_sidecar") > 0)
    return presence(records, sidecar, key).agg(
        F.count_if(F.col("n_sidecar") == 0).alias("missing_property_rows"),
        F.count_if(F.col("n_records") == 0).alias("missing_record_rows"),
        F.count_if((F.col("n_records") > 1) | (F.col("n_sidecar") > 1)).alias("repeated_record_ids"),
        F.count_if(both & ~F.col("record_key").eqNullSafe(F.col("sidecar_key"))).alias("mismatched_keys"),
    )


def require_aligned(records: DataFrame, sidecar: DataFrame, key: str | None = None) -> None:
    found = alignment_audit(records, sidecar, key).first().asDict()
    if any(found.values()):
        raise ValueError(f"the side table is not aligned with its records: {found}")


def key_mismatches(records: DataFrame, sidecar: DataFrame, key: str) -> DataFrame:
    return records.select("record_id", F.col(key).alias("record_key")).join(
        sidecar.select("record_id", F.col(key).alias("sidecar_key")), "record_id"
    ).filter(~F.col("record_key").eqNullSafe(F.col("sidecar_key")))


def usable_pairs(records: DataFrame, sidecar: DataFrame, status: str = "rdkit_status") -> DataFrame:
    """Records with their side-table columns, only where the status is ok.

    A column that both tables have is taken from the records.
    """
    shared = [c for c in sidecar.columns if c in records.columns and c != "record_id"]
    return records.join(sidecar.filter(F.col(status) == "ok").drop(status, *shared), "record_id")


def paired_issues(sidecar: DataFrame, status: str = "rdkit_status") -> DataFrame:
    """Side-table rows that cannot be paired, with the first reason."""
    reason = F.coalesce(
        F.when(F.coalesce(F.col(status) != "ok", F.lit(True)), "status"),
        F.when(F.coalesce(F.length("morgan_ecfp4_2048") != MORGAN_BYTES, F.lit(True)), "fingerprint_length"),
        F.when(F.coalesce(~F.col("maccs_keys_166_bits").rlike(f"^[01]{{{MACCS_BITS}}}$"), F.lit(True)), "bit_string"),
    )
    return sidecar.select("record_id", reason.alias("reason")).filter("reason is not null")


def with_descriptors(rows: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Left join of one descriptor row per record; a record may have many rows.

    Of several descriptor rows the smallest, compared column by column, is taken.
    """
    others = [c for c in descriptors.columns if c != "record_id"]
    single = descriptors.groupBy("record_id").agg(F.min(F.struct(*others)).alias("_first")).select("record_id", "_first.*")
    return rows.join(single, "record_id", "left")


def with_targets(records: DataFrame, labels: DataFrame) -> DataFrame:
    return records.join(labels, "record_id")


def common_records(representations: dict[str, DataFrame], by: tuple[str, ...] = (), record_id: str = "record_id") -> DataFrame:
    """IDs present in every representation (per split when `by` names it)."""
    if len(representations) > 62:
        raise ValueError("at most 62 representations")
    everyone = (1 << len(representations)) - 1
    tagged = union_all([
        df.select(*by, record_id, F.lit(1 << i).cast("bigint").alias("_bit"))
        for i, df in enumerate(representations.values())
    ])
    seen = tagged.groupBy(*by, record_id).agg(F.bit_or("_bit").alias("_seen"))
    return seen.filter(F.col("_seen") == everyone).drop("_seen")


def joined_embeddings(representations: dict[str, DataFrame], record_id: str = "record_id") -> DataFrame:
    """One row per common record with a column `<name>_embedding` per model."""
    parts = [
        df.select(record_id, F.col("embedding").alias(f"{name}_embedding"))
        for name, df in representations.items()
    ]
    return reduce(lambda a, b: a.join(b, record_id), parts)


def concatenated(representations: dict[str, DataFrame], record_id: str = "record_id") -> DataFrame:
    """The `a+b` representation: embeddings joined by record and laid end to end."""
    wide = joined_embeddings(representations, record_id)
    names = [f"{n}_embedding" for n in representations]
    return wide.select(record_id, F.concat(*names).alias("embedding"))


def invalid_vectors(cache: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    return cache.filter(~is_valid_vector(F.col(column), dimension))


def coordinate_statistics(train: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: mean and population deviation of every coordinate, as arrays."""
    vectors = train.select(array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    stats = vectors.agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")
    )
    n = F.col("s.count").cast("double")
    return stats.select(
        vector_to_array("s.mean").alias("mean"),
        F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n)).alias("std"),
    )


def standardized(rows: DataFrame, train: DataFrame, column: str = "embedding") -> DataFrame:
    """Coordinates minus the training mean over the training population deviation.

    The statistics are one row as wide as the embedding. A coordinate without
    training variance fails the job.
    """
    stats = coordinate_statistics(train, column).select(F.struct("mean", "std")).scalar()
    zero = F.exists(F.col("_s.std"), lambda s: s == 0)
    checked = F.when(
        zero, F.raise_error(F.lit("a coordinate has zero training variance")).cast("array<double>")
    )
    centred = F.zip_with(F.col(column), F.col("_s.mean"), lambda x, m: x.cast("double") - m)
    scaled = F.zip_with(centred, F.col("_s.std"), lambda x, s: x / s)
    return rows.withColumn("_s", stats).withColumn(column, F.coalesce(checked, scaled)).drop("_s")


def manifest_issues(manifest: DataFrame, splits: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """Why a split manifest is unusable: unknown splits, repeated records or molecules."""
    unknown = F.coalesce(
        ~F.col("split").isin(*splits) | F.col("record_id").isNull() | F.col("molecule_id").isNull(),
        F.lit(True),
    )

    def repeated(column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("rows")

    bad = manifest.agg(F.count_if(unknown).alias("rows")).select(F.lit("invalid_row").alias("issue"), "rows")
    found = [bad]
    for column, code in (("record_id", "repeated_record"), ("molecule_id", "repeated_molecule")):
        per = manifest.groupBy(column).agg(F.count("*").alias("n"))
        found.append(per.agg(repeated(column)).select(F.lit(code).alias("issue"), "rows"))
    return union_all(found)
