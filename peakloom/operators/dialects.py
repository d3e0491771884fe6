"""Requirements of the four published input dialects and of the own encoder.

`ranged` wants full annotated ranges, `tokenised` the five-part proton tuple,
`expanded` one shift per proton, and `encoder` only fixed-width limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions.binding import exploded
from peakloom.functions.text import normalize_multiplicity
from peakloom.operators.validate import issue, joined, peak_path, per_peak, present, record_issues
from peakloom.schema import MAX_J_VALUES, MAX_PEAKS

DIALECTS = ("ranged", "tokenised", "expanded", "shift_set")

# Vocabulary labels spelled differently by the ranged dialect.
RANGED_SPELLING = {"quint": "p", "sept": "hept", "bd": "brd"}


def ranged_multiplicity(p: Column, native: bool) -> Column:
    spelled = F.coalesce(
        *[F.when(p["multiplicity"] == label, F.lit(s)) for label, s in RANGED_SPELLING.items()],
        p["multiplicity"],
    )
    return F.when(F.length(p["multiplicity_raw"]) > 0, p["multiplicity_raw"]).otherwise(spelled) \
        if native else spelled


def tokenised_multiplicity(p: Column, native: bool) -> Column:
    if not native:
        return p["multiplicity"]
    return F.when(
        F.length(p["multiplicity_raw"]) > 0, normalize_multiplicity(p["multiplicity_raw"])
    ).otherwise(p["multiplicity"])


def _both_modalities() -> Column:
    def missing(column, code, label):
        n = F.coalesce(F.size(column), F.lit(0))
        return issue(n == 0, code, F.lit(column), f"{label} peaks are required")

    return present(
        missing("h_nmr_peaks", "missing_h_nmr", "1H"),
        missing("c_nmr_peaks", "missing_c_nmr", "13C"),
    )


def _too_many_peaks() -> list[Column]:
    return [
        issue(F.size(column) > MAX_PEAKS, f"too_many_{m}_peaks", F.lit(column),
              f"at most {MAX_PEAKS} {label} peaks")
        for m, column, label in (("h", "h_nmr_peaks", "1H"), ("c", "c_nmr_peaks", "13C"))
    ]


def _h(i: Column, suffix: str = "") -> Column:
    return peak_path("h_nmr_peaks", i, suffix)


def _not_positive(p: Column) -> Column:
    return F.coalesce(p["integration"] <= 0, F.lit(True))


def _ranged(native: bool) -> Column:
    def of_peak(p, i):
        outside = F.coalesce(~p["integration"].between(1, 50), F.lit(True))
        return present(
            issue(outside, "invalid_integration", _h(i, ".integration"),
                  "an integration from 1 to 50 is required"),
            issue(ranged_multiplicity(p, native).isNull(), "missing_multiplicity",
                  _h(i, ".multiplicity"), "a multiplicity is required"),
            issue(p["j_values"].isNull(), "missing_j_values", _h(i, ".j_values"),
                  "a J list is required; it may be empty"),
            issue(p["range_min"].isNull() | p["range_max"].isNull(), "missing_shift_range",
                  _h(i, ".range_min"), "both range ends are required"),
        )

    return joined(_both_modalities(), per_peak(F.col("h_nmr_peaks"), of_peak))


def _tokenised(native: bool) -> Column:
    def of_peak(p, i):
        no_width = p["range_half_span"].isNull() & (p["range_min"].isNull() | p["range_max"].isNull())
        return present(
            issue(_not_positive(p), "missing_integration", _h(i, ".integration"),
                  "a positive integration is required"),
            issue(tokenised_multiplicity(p, native).isNull(), "missing_multiplicity",
                  _h(i, ".multiplicity"), "a multiplicity is required"),
            issue(p["j_values"].isNull(), "missing_j_values", _h(i, ".j_values"),
                  "a J list is required; it may be empty"),
            issue(F.size(p["j_values"]) > MAX_J_VALUES, "too_many_j_values", _h(i, ".j_values"),
                  f"at most {MAX_J_VALUES} J values per peak"),
            issue(no_width, "missing_peak_width", _h(i, ".range_half_span"),
                  "a half span or both range ends are required"),
        )

    return joined(
        _both_modalities(), present(*_too_many_peaks()),
        per_peak(F.col("h_nmr_peaks"), of_peak),
    )


def _expanded() -> Column:
    def of_peak(p, i):
        members = p["member_shifts"]
        return present(
            issue(F.size(members) == 0, "empty_member_shifts", _h(i, ".member_shifts"),
                  "a member list must not be empty"),
            issue(members.isNull() & _not_positive(p), "missing_proton_expansion", _h(i),
                  "member shifts or a positive integration are required"),
        )

    return joined(_both_modalities(), per_peak(F.col("h_nmr_peaks"), of_peak))


def dialect_issues(dialect: str, native: bool = False, strict: bool = True) -> Column:
    """Issues of one record for one dialect; strict adds the schema rules first."""
    own = {
        "ranged": lambda: _ranged(native),
        "tokenised": lambda: _tokenised(native),
        "expanded": _expanded,
        "shift_set": _expanded,
    }[dialect]()
    return joined(record_issues(), own) if strict else own


def encoder_size_issues() -> Column:
    """Lists that are too long for the fixed-width encoder batch."""
    def of_peak(p, i):
        return present(issue(F.size(p["j_values"]) > MAX_J_VALUES, "too_many_j_values",
                             _h(i, ".j_values"), f"at most {MAX_J_VALUES} J values per peak"))

    return joined(present(*_too_many_peaks()), per_peak(F.col("h_nmr_peaks"), of_peak))


def encoder_issues() -> Column:
    """Everything that keeps a record out of the fixed-width encoder batch."""
    return joined(record_issues(), encoder_size_issues())


def compatibility_rows(records: DataFrame, strict: bool = True) -> DataFrame:
    """One row per record and dialect with its issue codes.

    The schema rules run once per record, and the two dialects with equal rules
    share one evaluation.
    """
    def codes(issues):
        return F.transform(issues, lambda x: x["code"])

    none = F.array().cast("array<string>")
    checked = records.select(
        "record_id",
        (codes(record_issues()) if strict else none).alias("_schema"),
        codes(_ranged(False)).alias("ranged"),
        codes(_tokenised(False)).alias("tokenised"),
        codes(_expanded()).alias("expanded"),
    )
    own = {"ranged": "ranged", "tokenised": "tokenised", "expanded": "expanded", "shift_set": "expanded"}
    rows = F.array(*[
        F.struct(F.lit(d).alias("dialect"), F.concat("_schema", own[d]).alias("codes")) for d in DIALECTS
    ])
    return exploded(checked, "record_id", items=rows).select("record_id", "item.*")


def compatibility_summary(records: DataFrame, strict: bool = True) -> DataFrame:
    return compatibility_rows(records, strict).groupBy("dialect").agg(
        F.count_if(F.size("codes") == 0).alias("accepted_records"),
        F.count_if(F.size("codes") > 0).alias("rejected_records"),
    )


def compatibility_issue_counts(records: DataFrame, strict: bool = True) -> DataFrame:
    """Issue occurrences, and records having the issue, per dialect and code."""
    counted = F.transform(
        F.array_distinct("codes"),
        lambda code: F.struct(code.alias("code"), F.size(F.filter("codes", lambda x: x == code)).alias("n")),
    )
    per_record = exploded(compatibility_rows(records, strict), "dialect", items=counted, name="hit")
    return per_record.groupBy("dialect", F.col("hit.code").alias("code")).agg(
        F.sum("hit.n").alias("occurrences"), F.count("*").alias("records")
    )
