"""Peak-list corruption as column operators with keyed random numbers.

A record gets the same corruption on every run; all draws come from digests of
seed, purpose and record ID.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.functions import keyed_random as R
from peakloom.functions.binding import let
from peakloom.schema import UNKNOWN_MULTIPLICITY


def _moved(peaks: Column, offset: Column) -> Column:
    return let(offset, lambda o: F.transform(peaks, lambda p: p.withField("shift", p["shift"] + o)))


def global_offset(shifts: Column, record_id: Column, purpose: str, low: float, high: float,
                  max_offset: float, probability: float, seed: int) -> Column:
    """One offset for a whole modality that keeps every peak in range, or 0."""
    least = F.greatest(F.lit(-float(max_offset)), F.lit(float(low)) - F.array_min(shifts))
    most = F.least(F.lit(float(max_offset)), F.lit(float(high)) - F.array_max(shifts))

    def drawn(d):
        used = (R.uniform(d, 1) < probability) & (F.size(shifts) > 0)
        return F.when(used, least + R.uniform(d, 0) * (most - least)).otherwise(F.lit(0.0))

    return let(R.digest(seed, f"global-{purpose}", record_id), drawn)


def global_shift(peaks: Column, record_id: Column, purpose: str, low: float, high: float,
                 max_offset: float, probability: float, seed: int) -> Column:
    shifts = F.transform(peaks, lambda p: p["shift"])
    return _moved(peaks, global_offset(shifts, record_id, purpose, low, high, max_offset, probability, seed))


def masked_peak(peaks: Column, record_id: Column, purpose: str, seed: int) -> Column:
    """0-based index of the peak to predict, null for an empty list."""
    scores = F.transform(
        peaks,
        lambda p, i: F.struct(R.uniform(R.digest(seed, f"mask-{purpose}", record_id, i)).alias("u"), (-i).alias("i")),
    )
    return -F.array_max(scores)["i"]


def local_jitter(peaks: Column, masked: Column, record_id: Column, purpose: str, low: float, high: float,
                 sigma: float, probability: float, seed: int) -> Column:
    """Gaussian noise on all peaks but the masked one; all shifts are clamped."""
    chosen = R.uniform(R.digest(seed, f"jitter-{purpose}", record_id)) < probability

    def of_record(used):
        def moved(p, i):
            noise = R.normal(R.digest(seed, f"noise-{purpose}", record_id, i)) * F.lit(float(sigma))
            shift = F.when(used & (i != masked), p["shift"] + noise).otherwise(p["shift"])
            return p.withField("shift", F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), shift)))

        return F.transform(peaks, moved)

    return let(chosen, of_record)


def masked_annotations(h: Column, record_id: Column, probability: float, seed: int) -> Column:
    """Drop annotations: integration for the whole spectrum, the others per peak.

    A multiplicity of `<unk>` is never dropped. A dropped range loses its ends
    together with the half span.
    """
    draw = R.uniform(R.digest(seed, "annotation", record_id))

    def of_record(whole):
        def dropped(p, i):
            def with_draws(d):
                keep_m = (R.uniform(d, 0) >= probability) | (p["multiplicity"] == UNKNOWN_MULTIPLICITY)
                keep_j, keep_r = R.uniform(d, 1) >= probability, R.uniform(d, 2) >= probability
                q = p.withField("integration", F.when(whole >= probability, p["integration"]))
                q = q.withField("multiplicity", F.when(keep_m, p["multiplicity"]))
                q = q.withField("j_values", F.when(keep_j, p["j_values"]))
                for name in ("range_min", "range_max", "range_half_span"):
                    q = q.withField(name, F.when(keep_r, p[name]))
                return q

            return let(R.digest(seed, "annotation", record_id, i), with_draws)

        return F.transform(h, dropped)

    return let(draw, of_record)


def dropped_modality(h: Column, c: Column, record_id: Column, probability: float, seed: int) -> Column:
    """`h`, `c` or null: which modality to drop; only where both are present."""
    d = R.digest(seed, "modality", record_id)
    both = (F.size(h) > 0) & (F.size(c) > 0)
    side = F.when(R.uniform(d, 1) < 0.5, F.lit("h")).otherwise(F.lit("c"))
    return F.when(both & (R.uniform(d, 0) < probability), side)
