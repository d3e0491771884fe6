"""Model input columns: label IDs, dialect fields, padding and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.functions import peaks as P
from peakloom.functions.binding import let
from peakloom.functions.text import literal_map
from peakloom.operators.dialects import ranged_multiplicity, tokenised_multiplicity
from peakloom.schema import MAX_J_VALUES, MAX_PEAKS, MULTIPLICITIES, UNKNOWN_MULTIPLICITY

CARBON_SCALE_PPM = 220.0
# Positions: null 0, <unk> 1, then the vocabulary.
MULTIPLICITY_ID = {UNKNOWN_MULTIPLICITY: 1, **{m: i + 2 for i, m in enumerate(MULTIPLICITIES)}}
# Released index of the tokenised dialect: <unk> 0, then the vocabulary.
TOKENISED_INDEX = {UNKNOWN_MULTIPLICITY: 0, **{m: i + 1 for i, m in enumerate(MULTIPLICITIES)}}


def multiplicity_id(label: Column) -> Column:
    return F.when(label.isNull(), F.lit(0)).otherwise(F.try_element_at(literal_map(MULTIPLICITY_ID), label))


def multiplicity_label(number: Column) -> Column:
    return F.try_element_at(literal_map({i: m for m, i in MULTIPLICITY_ID.items()}), number)


def tokenised_index(label: Column) -> Column:
    return F.try_element_at(literal_map(TOKENISED_INDEX), label)


def padded(values: Column, width: int, zero) -> Column:
    """The list extended by `zero` to exactly `width` entries; a longer list fails the job."""
    def extended(v: Column) -> Column:
        size = F.size(v)
        stop = F.raise_error(F.concat(size.cast("string"), F.lit(f" entries where at most {width} fit")))
        fitting = F.concat(v, F.array_repeat(zero, F.greatest(F.lit(width) - size, F.lit(0))))
        return F.when(size <= width, fitting).otherwise(stop)

    return let(values, extended)


def mask(n: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: i <= n)


def encoder_columns(width: int = MAX_PEAKS, j_width: int = MAX_J_VALUES) -> dict[str, Column]:
    """Fixed-width arrays, masks and availability flags of one record.

    Only for records without encoder issues: a longer list fails the job, it is
    never cut.
    """
    h, c = F.col("h_nmr_peaks"), F.col("c_nmr_peaks")
    zero = F.lit(0.0)
    no_j = F.array_repeat(zero, j_width)
    no_mask = F.array_repeat(F.lit(False), j_width)

    def field(peaks, of, empty=zero):
        return padded(F.transform(peaks, of), width, empty)

    def flags(p):
        return F.array(*[
            p[name].isNotNull() for name in ("integration", "multiplicity", "j_values", "range_half_span")
        ])

    j_or_empty = lambda p: F.coalesce(p["j_values"], F.array().cast("array<double>"))
    return {
        "h_shift": field(h, lambda p: p["shift"]),
        "h_integration": field(h, lambda p: F.coalesce(p["integration"].cast("double"), zero)),
        "h_multiplicity": field(h, lambda p: multiplicity_id(p["multiplicity"]), F.lit(0)),
        "h_j_values": field(h, lambda p: padded(j_or_empty(p), j_width, zero), no_j),
        "h_range_half_span": field(h, lambda p: F.coalesce(p["range_half_span"], zero)),
        "h_peak_mask": mask(F.size(h), width),
        "h_j_mask": field(h, lambda p: mask(F.size(j_or_empty(p)), j_width), no_mask),
        "h_availability": field(h, flags, F.array_repeat(F.lit(False), 4)),
        "c_shift": field(c, lambda p: p["shift"]),
        "c_peak_mask": mask(F.size(c), width),
    }


def proton_inputs(width: int = MAX_PEAKS, j_width: int = MAX_J_VALUES) -> Column:
    """The proton fields of `encoder_columns` as one array of structs, built in a single pass over the peaks.

    For consumers that read peak by peak. A longer list fails the job.
    """
    zero = F.lit(0.0)
    no_j = F.array().cast("array<double>")

    def entry(shift, integration, multiplicity, j, half, known, present) -> Column:
        return F.struct(
            shift.alias("shift"), integration.alias("integration"), multiplicity.alias("multiplicity"), j.alias("j_values"),
            half.alias("range_half_span"), F.lit(known).alias("peak_mask"), present.alias("availability"))

    def of(p: Column) -> Column:
        present = F.array(*[p[n].isNotNull() for n in ("integration", "multiplicity", "j_values", "range_half_span")])
        j = let(F.coalesce(p["j_values"], no_j), lambda v: F.struct(
            padded(v, j_width, zero).alias("values"), mask(F.size(v), j_width).alias("mask")))
        return entry(p["shift"], F.coalesce(p["integration"].cast("double"), zero), multiplicity_id(p["multiplicity"]), j,
                     F.coalesce(p["range_half_span"], zero), True, present)

    blank_j = F.struct(F.array_repeat(zero, j_width).alias("values"), F.array_repeat(F.lit(False), j_width).alias("mask"))
    blank = entry(zero, zero, F.lit(0), blank_j, zero, False, F.array_repeat(F.lit(False), 4))
    return padded(F.transform("h_nmr_peaks", of), width, blank)


def sequence_columns(width: int) -> dict[str, Column]:
    """One shift sequence, protons first: shifts, counts, types and padding mask.

    A sequence longer than `width` fails the job.
    """
    h = P.expanded_proton_shifts(F.col("h_nmr_peaks"))
    c = F.transform("c_nmr_peaks", lambda p: p["shift"])
    n_h, n_c = F.size(h), F.size(c)
    total = n_h + n_c
    return {
        "sequence_length": total,
        "shifts": padded(F.concat(h, c), width, F.lit(0.0)),
        "counts": padded(F.array_repeat(F.lit(1.0), n_h), width, F.lit(0.0)),
        "types": padded(F.concat(F.array_repeat(F.lit(0), n_h), F.array_repeat(F.lit(1), n_c)), width, F.lit(0)),
        "padding_mask": F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: i > total),
    }


def scaled_carbon(c: Column) -> Column:
    """Carbon shifts on [0, 1], clamped."""
    return F.transform(
        c, lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p["shift"] / F.lit(CARBON_SCALE_PPM)))
    )


def plain_number(v: Column) -> Column:
    """A double as text; values from 0.0001 up to a thousandth without an exponent."""
    small = (F.abs(v) < 1e-3) & (F.abs(v) >= 1e-4)
    return F.when(small, F.rtrim(v.cast("decimal(38,24)").cast("string"), F.lit("0"))).otherwise(v.cast("string"))


def j_text(j_values: Column) -> Column:
    """`7.2_2.1`, or `_` for no values."""
    joined = F.array_join(F.transform(j_values, plain_number), "_")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("_"))


def ranged_protons(h: Column, native: bool = False) -> Column:
    return F.transform(
        h,
        lambda p: F.struct(
            p["shift"].alias("centroid"),
            p["range_min"].alias("rangeMin"),
            p["range_max"].alias("rangeMax"),
            ranged_multiplicity(p, native).alias("category"),
            p["integration"].cast("int").alias("nH"),
            j_text(p["j_values"]).alias("j_values"),
        ),
    )


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def tokenised_json(h: Column, c: Column, native: bool = False) -> Column:
    """The tokenised dialect's JSON text: five-part proton tuples, carbon shifts."""
    def number(v):
        return v.cast("string")

    def tuple_of(p):
        half = F.coalesce(p["range_half_span"], (p["range_max"] - p["range_min"]) / F.lit(2.0))
        quoted = F.concat(F.lit('"'), tokenised_multiplicity(p, native), F.lit('"'))
        return _json_list(F.array(
            number(p["shift"]), number(half), quoted,
            F.concat(F.lit('"'), p["integration"].cast("string"), F.lit('H"')),
            _json_list(F.transform(F.coalesce(p["j_values"], F.array().cast("array<double>")), number)),
        ))

    return F.concat(
        F.lit('{"1HNMR": '), _json_list(F.transform(h, tuple_of)),
        F.lit(', "13CNMR": '), _json_list(F.transform(c, lambda p: number(p["shift"]))), F.lit("}"),
    )
