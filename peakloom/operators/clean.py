"""Filter by the common cleaning policy, then remove exact duplicates.

Duplicates share the molecule key and both sorted shift lists. The winner of a
group has the most annotations, then the fewest missing or unknown ones, then
the smallest record ID. Groups are reduced by partial aggregation, so a group
that holds a large part of the table never meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions import peaks as P
from peakloom.functions.text import molecule_key
from peakloom.schema import C_CLEAN_RANGE, H_CLEAN_RANGE, MAX_J_VALUES, MAX_PEAKS
from peakloom.session import cut_lineage

# Removal reasons in report order.
FILTER_REASONS = (
    "no_nmr_peaks",
    "non_finite_h_shift",
    "h_shift_out_of_range",
    "non_finite_c_shift",
    "c_shift_out_of_range",
    "too_many_h_peaks",
    "too_many_c_peaks",
    "too_many_j_values",
    "invalid_j_value",
    "non_positive_h_integration",
    "multifragment_smiles",
)
DUPLICATE_REASON = "duplicate_shift_signature"
SIGNATURE = ["_molecule_key", "_h_shifts", "_c_shifts"]


@dataclass(frozen=True)
class CleaningPolicy:
    key: str = "smiles_canonical"
    h_range: tuple[float, float] = H_CLEAN_RANGE
    c_range: tuple[float, float] = C_CLEAN_RANGE
    max_peaks: int = MAX_PEAKS
    max_j_values: int = MAX_J_VALUES


def reason_flags(policy: CleaningPolicy) -> dict[str, Column]:
    h, c = F.col("h_nmr_peaks"), F.col("c_nmr_peaks")
    n_h, n_c = P.peak_count(h), P.peak_count(c)
    return {
        "no_nmr_peaks": (n_h == 0) & (n_c == 0),
        "non_finite_h_shift": P.has_non_finite_shift(h),
        "h_shift_out_of_range": P.has_shift_outside(h, *policy.h_range),
        "non_finite_c_shift": P.has_non_finite_shift(c),
        "c_shift_out_of_range": P.has_shift_outside(c, *policy.c_range),
        "too_many_h_peaks": n_h > policy.max_peaks,
        "too_many_c_peaks": n_c > policy.max_peaks,
        "too_many_j_values": P.has_too_many_j(h, policy.max_j_values),
        "invalid_j_value": P.has_invalid_j(h),
        "non_positive_h_integration": P.has_non_positive_integration(h),
        "multifragment_smiles": F.coalesce(
            F.contains(F.col(policy.key), F.lit(".")), F.lit(False)
        ),
    }


def failed_reasons(policy: CleaningPolicy) -> Column:
    """All failed rules joined with `;` in report order, null when none failed."""
    flags = reason_flags(policy)
    joined = F.concat_ws(";", *[F.when(flags[r], F.lit(r)) for r in FILTER_REASONS])
    return F.nullif(joined, F.lit(""))


def audit(records: DataFrame, policy: CleaningPolicy) -> DataFrame:
    """The compact projection on which filtering and deduplication work."""
    h, c = F.col("h_nmr_peaks"), F.col("c_nmr_peaks")
    return records.select(
        "record_id",
        failed_reasons(policy).alias("_reasons"),
        molecule_key(F.col(policy.key), F.col("record_id")).alias("_molecule_key"),
        P.sorted_shifts(h).alias("_h_shifts"),
        P.sorted_shifts(c).alias("_c_shifts"),
        F.struct(
            (-P.annotation_count(h)).alias("fewer"),
            P.missing_or_unknown_count(h).alias("missing"),
            F.col("record_id").alias("record_id"),
        ).alias("_rank"),
    )


def duplicate_losers(audited: DataFrame) -> DataFrame:
    """(record_id, duplicate_of) for every record that is not its group's winner.

    Only hashes travel for the bulk of the table; full signatures are compared
    for the few rows whose hash repeats, so equal hashes alone never decide.
    """
    hashed = audited.withColumn("_hash", F.xxhash64(*SIGNATURE))
    repeated = hashed.groupBy("_hash").count().filter("count > 1").select("_hash")
    candidates = hashed.join(repeated, "_hash", "left_semi")
    winners = (
        candidates.groupBy("_hash", *SIGNATURE)
        .agg(F.min("_rank").alias("_best"), F.count("*").alias("_size"))
        .filter("_size > 1")
    )
    return (
        candidates.join(winners, ["_hash", *SIGNATURE])
        .filter(F.col("record_id") != F.col("_best.record_id"))
        .select("record_id", F.col("_best.record_id").alias("duplicate_of"))
    )


def removals(records: DataFrame, policy: CleaningPolicy = CleaningPolicy(), staged: bool = False) -> DataFrame:
    """One row per removed record: record_id, removal_reason, duplicate_of.

    `staged` writes the compact audit columns to the shared scratch folder once,
    instead of computing them for each of the four passes.
    """
    audited = audit(records, policy)
    return removals_of_audit(cut_lineage(audited) if staged else audited)


def removals_of_audit(audited: DataFrame) -> DataFrame:
    failed = audited.filter(F.col("_reasons").isNotNull()).select(
        "record_id",
        F.col("_reasons").alias("removal_reason"),
        F.lit(None).cast("string").alias("duplicate_of"),
    )
    losers = duplicate_losers(audited.filter(F.col("_reasons").isNull()))
    return failed.unionByName(
        losers.select("record_id", F.lit(DUPLICATE_REASON).alias("removal_reason"), "duplicate_of")
    )


def clean(records: DataFrame, policy: CleaningPolicy = CleaningPolicy(), staged: bool = False) -> DataFrame:
    """The records that pass every rule and win their duplicate group.

    The rules are tested again on the records, so only the duplicates, few in
    number, take part in a join.
    """
    audited = audit(records, policy).filter(F.col("_reasons").isNull())
    losers = duplicate_losers(cut_lineage(audited) if staged else audited)
    passing = records.filter(failed_reasons(policy).isNull())
    return passing.join(losers.select("record_id"), "record_id", "left_anti")


def reason_counts(removed: DataFrame) -> DataFrame:
    """Removals per reason; a row with several reasons counts in each."""
    return (
        removed.select(F.explode(F.split("removal_reason", ";")).alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("records"))
    )


def reconciliation(records: DataFrame, removed: DataFrame) -> DataFrame:
    """Input, filtered, duplicate and kept counts in one row."""
    totals = records.agg(F.count("*").alias("input_records"))
    by_kind = removed.agg(
        F.count_if(F.col("duplicate_of").isNull()).alias("filtered_records"),
        F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicate_records"),
    )
    return by_kind.withColumn("input_records", totals.scalar()).withColumn(
        "output_records",
        F.col("input_records") - F.col("filtered_records") - F.col("duplicate_records"),
    )
