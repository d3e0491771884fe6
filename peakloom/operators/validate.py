"""Record validation that reports every issue with its place, and table guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.binding import pos_exploded
from peakloom.functions.text import is_finite, strip
from peakloom.schema import (
    DESCRIPTORS,
    FUNCTIONAL_FLAGS,
    MULTIPLICITIES,
    UNKNOWN_MULTIPLICITY,
)

ISSUE_TYPE = "struct<code:string,path:string,message:string>"
NUMBER_MESSAGE = "must be a finite number"


def issue(condition: Column, code: str, path: Column, message: str) -> Column:
    """An issue struct where the condition holds, else null."""
    return F.when(
        condition,
        F.struct(F.lit(code).alias("code"), path.alias("path"), F.lit(message).alias("message")),
    )


def no_issues() -> Column:
    return F.array().cast(f"array<{ISSUE_TYPE}>")


def present(*maybe_issues: Column) -> Column:
    return F.filter(F.array(*maybe_issues), lambda x: x.isNotNull())


def joined(*issue_arrays: Column) -> Column:
    return F.concat(*[F.coalesce(a, no_issues()) for a in issue_arrays])


def peak_path(modality: str, i: Column, suffix: str = "") -> Column:
    return F.concat(F.lit(f"{modality}["), i.cast("string"), F.lit(f"]{suffix}"))


def per_peak(peaks: Column, issues_of) -> Column:
    """Issues of all peaks in list order; `issues_of(peak, index)` is an array."""
    return F.flatten(F.transform(peaks, issues_of))


def _bad_number(value: Column, optional: bool) -> Column:
    bad = ~is_finite(value)
    return F.coalesce(bad, F.lit(False)) if optional else F.coalesce(bad, F.lit(True))


def _list_numbers(values: Column, base: Column) -> Column:
    found = F.transform(
        values,
        lambda v, k: issue(
            _bad_number(v, optional=False),
            "invalid_number",
            F.concat(base, F.lit("["), k.cast("string"), F.lit("]")),
            NUMBER_MESSAGE,
        ),
    )
    return F.filter(found, lambda x: x.isNotNull())


def _all_finite(values: Column) -> Column:
    return F.coalesce(values.isNull() | F.forall(values, is_finite), F.lit(False))


def _proton_is_clean(p: Column) -> Column:
    """A quick test that no rule is broken; most peaks need no more."""
    low, high, half, shift = p["range_min"], p["range_max"], p["range_half_span"], p["shift"]
    expected = (high - low) / F.lit(2.0)
    ranged = (
        is_finite(low) & is_finite(high) & shift.between(low, high)
        & (half.isNull() | (is_finite(half) & (half >= 0) & (F.abs(half - expected) <= F.lit(1e-8))))
    )
    unranged = low.isNull() & high.isNull() & (half.isNull() | (is_finite(half) & (half >= 0)))
    clean = (
        is_finite(shift)
        & (p["integration"].isNull() | (p["integration"] >= 0))
        & (p["multiplicity"].isNull() | p["multiplicity"].isin(*MULTIPLICITIES, UNKNOWN_MULTIPLICITY))
        & (F.coalesce(ranged, F.lit(False)) | unranged)
        & _all_finite(p["j_values"])
        & _all_finite(p["member_shifts"])
    )
    return F.coalesce(clean, F.lit(False))


def _proton_issues(p: Column, i: Column) -> Column:
    return F.when(~_proton_is_clean(p), _located_proton_issues(p, i)).otherwise(no_issues())


def _located_proton_issues(p: Column, i: Column) -> Column:
    def at(suffix=""):
        return peak_path("h_nmr_peaks", i, suffix)

    low, high, half, shift = p["range_min"], p["range_max"], p["range_half_span"], p["shift"]
    ends = F.coalesce(is_finite(low) & is_finite(high), F.lit(False))
    ordered = ends & (low <= high)
    half_ok = F.coalesce(is_finite(half), F.lit(False))
    expected = (high - low) / F.lit(2.0)
    slack = F.greatest(
        F.lit(1e-6) * F.greatest(F.abs(half), F.abs(expected)), F.lit(1e-8)
    )
    return joined(
        present(
            issue(_bad_number(shift, False), "invalid_number", at(".shift"), NUMBER_MESSAGE),
            issue(p["integration"] < 0, "invalid_integration", at(".integration"),
                  "must be a non-negative integer or null"),
            issue(~p["multiplicity"].isin(*MULTIPLICITIES, UNKNOWN_MULTIPLICITY),
                  "invalid_multiplicity", at(".multiplicity"),
                  "must be a vocabulary label, <unk> or null"),
        ),
        _list_numbers(p["j_values"], at(".j_values")),
        present(
            issue(_bad_number(low, True), "invalid_number", at(".range_min"), NUMBER_MESSAGE),
            issue(_bad_number(high, True), "invalid_number", at(".range_max"), NUMBER_MESSAGE),
            issue(_bad_number(half, True), "invalid_number", at(".range_half_span"), NUMBER_MESSAGE),
            issue(low.isNull() != high.isNull(), "incomplete_range", at(),
                  "both range ends must be supplied together"),
            issue(ends & (low > high), "invalid_range", at(),
                  "range_min must not exceed range_max"),
            issue(ordered & is_finite(shift) & ~shift.between(low, high),
                  "shift_outside_range", at(".shift"), "shift must lie within its range"),
            issue(half_ok & (half < 0), "invalid_range", at(".range_half_span"),
                  "must not be negative"),
            issue(ends & half_ok & (F.abs(half - expected) > slack), "inconsistent_range",
                  at(".range_half_span"), "must be half the distance of the range ends"),
        ),
        _list_numbers(p["member_shifts"], at(".member_shifts")),
    )


def _carbon_issues(p: Column, i: Column) -> Column:
    extra = ("integral", "intensity", "width")
    clean = is_finite(p["shift"])
    for name in extra:
        clean = clean & (p[name].isNull() | is_finite(p[name]))
    found = present(
        issue(_bad_number(p["shift"], False), "invalid_number",
              peak_path("c_nmr_peaks", i, ".shift"), NUMBER_MESSAGE),
        *[
            issue(_bad_number(p[name], True), "invalid_number",
                  peak_path("c_nmr_peaks", i, f".{name}"), NUMBER_MESSAGE)
            for name in extra
        ],
    )
    return F.when(~F.coalesce(clean, F.lit(False)), found).otherwise(no_issues())


def record_issues() -> Column:
    """All schema-rule issues of one canonical record, in field order."""
    no_id = F.coalesce(strip(F.col("record_id")) == "", F.lit(True))
    return joined(
        present(issue(no_id, "invalid_record_id", F.lit("record_id"), "must be a non-empty string")),
        per_peak(F.col("h_nmr_peaks"), _proton_issues),
        per_peak(F.col("c_nmr_peaks"), _carbon_issues),
    )


def validate(records: DataFrame) -> DataFrame:
    return records.withColumn("issues", record_issues())


def issue_rows(records: DataFrame) -> DataFrame:
    """One row per issue."""
    rows = pos_exploded(records, "record_id", items=record_issues(), pos="issue_no")
    return rows.select("record_id", "issue_no", "item.*")


def checked(records: DataFrame) -> DataFrame:
    """Fail the job at the first invalid record, naming all of its issues."""
    found = record_issues()
    message = F.concat(
        F.lit("record "), F.coalesce("record_id", F.lit("<unknown>")), F.lit(" is incompatible: "),
        F.concat_ws("; ", F.transform(found, lambda x: F.concat(x["path"], F.lit(": "), x["message"]))),
    )
    keep = F.when(F.size(found) > 0, F.raise_error(message).cast("boolean")).otherwise(True)
    return records.filter(keep)


def empty_key_audit(rows: DataFrame, columns: list[str], row_no: str) -> DataFrame:
    """Per column: rows with a null or empty key, and the first such row number."""
    def empty(c):
        return F.coalesce(F.col(c) == "", F.lit(True))

    counted = rows.agg(
        *[F.count_if(empty(c)).alias(f"{c}__n") for c in columns],
        *[F.min(F.when(empty(c), F.col(row_no))).alias(f"{c}__row") for c in columns],
    )
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"{c}__n").alias("empty_rows"),
            F.col(f"{c}__row").alias("first_row"),
        )
        for c in columns
    ])
    return counted.select(F.inline(pairs))


def require_keys(rows: DataFrame, columns: list[str], row_no: str) -> None:
    """Raise if any key column holds a null or empty value."""
    bad = empty_key_audit(rows, columns, row_no).filter("empty_rows > 0").collect()
    if bad:
        raise ValueError("; ".join(
            f"{r.column_name} is empty in {r.empty_rows} rows, first at row {r.first_row}"
            for r in bad
        ))


def first_invalid_property(
    status: Column,
    flags: tuple[str, ...] = FUNCTIONAL_FLAGS,
    descriptors: tuple[str, ...] = DESCRIPTORS,
    status_name: str = "rdkit_status",
) -> Column:
    """The first field that makes a property row unusable, null if complete."""
    tests = [F.when(F.coalesce(status != "ok", F.lit(True)), F.lit(status_name))]
    tests += [
        F.when(F.coalesce(~F.col(name).isin(0, 1), F.lit(True)), F.lit(name)) for name in flags
    ]
    tests += [
        F.when(F.coalesce(~is_finite(F.col(name).cast("double")), F.lit(True)), F.lit(name))
        for name in descriptors
    ]
    return F.coalesce(*tests)
