"""Expressions over the two nested peak lists.

Null means "not available" and an empty list means "available and empty"; the
two modality lists are the exception and count as empty when null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.functions.text import is_finite
from peakloom.schema import CARBON_PEAK, PROTON_PEAK, UNKNOWN_MULTIPLICITY

EMPTY_PROTONS = f"array<{PROTON_PEAK.simpleString()}>"
EMPTY_CARBONS = f"array<{CARBON_PEAK.simpleString()}>"


def peak_count(peaks: Column) -> Column:
    return F.coalesce(F.size(peaks), F.lit(0))


def any_peak(peaks: Column, test) -> Column:
    """`exists` that treats null elements, null results and null lists as false."""
    return F.coalesce(F.exists(peaks, lambda p: F.coalesce(test(p), F.lit(False))), F.lit(False))


def filled(peaks: Column, element_type: str) -> Column:
    return F.coalesce(peaks, F.array().cast(element_type))


def sorted_shifts(peaks: Column) -> Column:
    return F.coalesce(F.sort_array(peaks["shift"]), F.array().cast("array<double>"))


def _bit(condition: Column) -> Column:
    return condition.cast("int")


def range_known(p: Column) -> Column:
    return p["range_half_span"].isNotNull() | (
        p["range_min"].isNotNull() & p["range_max"].isNotNull()
    )


def _summed(peaks: Column, per_peak) -> Column:
    total = F.aggregate(peaks, F.lit(0), lambda acc, p: acc + per_peak(p))
    return F.coalesce(total, F.lit(0))


def annotation_count(h: Column) -> Column:
    """Annotations present over all proton peaks; `<unk>` counts as present."""
    return _summed(
        h,
        lambda p: _bit(p["integration"].isNotNull())
        + _bit(p["multiplicity"].isNotNull())
        + _bit(p["j_values"].isNotNull())
        + _bit(range_known(p)),
    )


def missing_or_unknown_count(h: Column) -> Column:
    """Annotations missing over all proton peaks; `<unk>` counts as missing."""
    return _summed(
        h,
        lambda p: _bit(p["integration"].isNull())
        + _bit(F.coalesce(p["multiplicity"] == UNKNOWN_MULTIPLICITY, F.lit(True)))
        + _bit(p["j_values"].isNull())
        + _bit(~range_known(p)),
    )


def has_non_finite_shift(peaks: Column) -> Column:
    """The ends tell: NaN counts as the largest value, and nulls are passed over."""
    least, most = F.array_min(peaks["shift"]), F.array_max(peaks["shift"])
    return F.coalesce(~is_finite(least) | ~is_finite(most), F.lit(False))


def has_shift_outside(peaks: Column, low: float, high: float) -> Column:
    """Bounds are inclusive and only finite shifts are tested; most lists are settled by their ends."""
    inside = (F.array_min(peaks["shift"]) >= low) & (F.array_max(peaks["shift"]) <= high)
    outside = any_peak(
        peaks,
        lambda p: is_finite(p["shift"]) & ((p["shift"] < low) | (p["shift"] > high)),
    )
    return F.when(inside, False).otherwise(outside)


def has_too_many_j(h: Column, limit: int) -> Column:
    return any_peak(h, lambda p: F.size(p["j_values"]) > limit)


def has_invalid_j(h: Column) -> Column:
    return any_peak(
        h,
        lambda p: F.exists(
            p["j_values"], lambda j: F.coalesce(~is_finite(j) | (j < 0), F.lit(False))
        ),
    )


def has_non_positive_integration(h: Column) -> Column:
    return F.coalesce(F.array_min(h["integration"]) <= 0, F.lit(False))


def statistics(atoms: Column, h: Column, c: Column) -> dict[str, Column]:
    """Atom and peak counts, and peaks per atom where there are atoms."""
    n, nh, nc = F.size(atoms), F.size(h), F.size(c)
    return {
        "num_atoms": n,
        "n_h_peaks": nh,
        "n_c_peaks": nc,
        "h_peaks_per_atom": F.when(n > 0, nh.cast("double") / n),
        "c_peaks_per_atom": F.when(n > 0, nc.cast("double") / n),
    }


def expanded_proton_shifts(h: Column) -> Column:
    """Member shifts where given, else the peak shift once per proton."""
    return F.flatten(
        F.transform(
            h,
            lambda p: F.when(F.size(p["member_shifts"]) > 0, p["member_shifts"]).otherwise(
                F.array_repeat(p["shift"], F.coalesce(p["integration"], F.lit(0)).cast("int"))
            ),
        )
    )
