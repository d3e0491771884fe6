"""Label cohorts: match external labels to records without leaking molecules.

Labels carry `endpoint`, `split`, a molecule key, the label text and a row
number. Agreement is decided on one aggregated row per key, so a key with very
many labels or records never gathers in one task before the final expansion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.text import numeric_label, seeded_digest
from peakloom.operators.ranking import position_by_score

RELEASE = ["endpoint", "split"]
# The two splits of a released endpoint.
SPLITS = ("train_val", "test")


def cross_split_keys(labels: DataFrame, key: str = "key") -> DataFrame:
    """(endpoint, key) that occur in more than one split of the endpoint."""
    bit = F.coalesce(*[F.when(F.col("split") == s, F.lit(1 << i)) for i, s in enumerate(SPLITS)])
    return (
        labels.groupBy("endpoint", key)
        .agg(F.bit_or(bit).alias("_splits"))
        .filter(F.bit_count("_splits") > 1)
        .select("endpoint", key)
    )


def drop_cross_split(labels: DataFrame, key: str = "key") -> DataFrame:
    return labels.join(cross_split_keys(labels, key), ["endpoint", key], "left_anti")


def consolidate(labels: DataFrame, key: str = "key", label: str = "label", row_no: str = "row_no") -> DataFrame:
    """One row per release and key: agreement, number of rows, first row's label.

    Labels agree when they are numerically equal; an unreadable or non-finite
    label fails the job.
    """
    value = F.coalesce(
        numeric_label(F.col(label)),
        F.raise_error(F.concat(F.lit("invalid label for "), F.col(key), F.lit(": "),
                               F.coalesce(F.col(label), F.lit("null")))).cast("double"),
    )
    return (
        labels.withColumn("_value", value)
        .groupBy(*RELEASE, key)
        .agg(
            F.count("*").alias("label_rows"),
            F.min("_value").alias("_low"),
            F.max("_value").alias("_high"),
            F.min(F.struct(F.col(row_no), F.col(label))).alias("_first"),
        )
        .select(
            *RELEASE,
            key,
            "label_rows",
            (F.col("_low") != F.col("_high")).alias("discordant"),
            F.col(f"_first.{row_no}").alias(row_no),
            F.col(f"_first.{label}").alias(label),
        )
    )


def expand(consolidated: DataFrame, records: DataFrame, key: str = "key") -> DataFrame:
    """One output row per record of every agreeing key."""
    agreeing = consolidated.filter(~F.col("discordant")).drop("discordant", "label_rows")
    return records.select("record_id", key).join(agreeing, key)


def release_statistics(consolidated: DataFrame, records: DataFrame, key: str = "key") -> DataFrame:
    """Matching counters per release."""
    sizes = records.groupBy(key).agg(F.count("*").alias("n_records"))
    agreeing = ~F.col("discordant")
    return (
        consolidated.join(sizes, key)
        .groupBy(*RELEASE)
        .agg(
            F.sum("label_rows").alias("matched_property_rows"),
            F.sum("n_records").alias("matched_records"),
            F.sum(F.when(agreeing, F.col("n_records")).otherwise(0)).alias("output_records"),
            F.count_if(agreeing & (F.col("label_rows") > 1)).alias("agreeing_duplicates"),
            F.count_if("discordant").alias("discordant_molecules"),
        )
    )


def training_pool(records: DataFrame, labels: DataFrame, key: str = "key") -> DataFrame:
    """Records of no labelled molecule, whatever became of the label."""
    return records.join(labels.select(key).distinct(), key, "left_anti")


def fraction_split(keys: DataFrame, key: str, fraction: float, seed: int,
                   names: tuple[str, str] = SPLITS) -> DataFrame:
    """Assign each distinct key to one of two splits by its seeded digest.

    The first split gets `fraction` of the keys, rounded half to even, and at
    least one key is left on either side.
    """
    if not 0.0 < fraction < 1.0:
        raise ValueError("the fraction must lie between 0 and 1")
    distinct = keys.select(key).distinct()
    ranked = position_by_score(distinct, seeded_digest(F.col(key), seed), [F.col(key)])
    n = F.col("group_size")
    wanted = F.bround(n.cast("double") * F.lit(fraction), 0).cast("bigint")
    size = F.least(F.greatest(wanted, F.lit(1)), n - 1)
    enough = F.when(n < 2, F.raise_error(F.lit("a split needs at least two keys")).cast("string"))
    split = F.coalesce(enough, F.when(F.col("position") <= size, names[0]).otherwise(names[1]))
    return ranked.select(key, split.alias("split"))


def split_labels(labels: DataFrame, records: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Split an unsplit release over the molecules that have records."""
    matched = labels.select(key).distinct().join(records.select(key), key, "left_semi")
    return labels.join(fraction_split(matched, key, fraction, seed), key)
