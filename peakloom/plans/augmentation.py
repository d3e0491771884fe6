"""Reproducible corruption of peak lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.functions.binding import exploded, pos_exploded
from peakloom.operators import augment as A
from peakloom.plans.registry import query
from peakloom.plans.sql import RECORDS
from peakloom.plans.views import spectra
from peakloom.schema import C_BIN_RANGE, H_BIN_RANGE

SEED = 11


def u(text, draw=0):
    """SQL for one uniform draw from a keyed digest."""
    return f"(('0x' || substr(sha256({text}), {1 + 13 * draw}, 13))::bigint / 4503599627370496e0)"


def key(purpose, *parts):
    return f"'{SEED}:{purpose}'" + "".join(f" || ':' || {p}" for p in parts)


MOVED = RECORDS + f""",
lim as (select record_id, min(shift) as lo, max(shift) as hi from pk where nucleus = 'h' group by 1),
off as (select record_id, case when {u(key('global-h', 'record_id'), 1)} < 0.5 then
  greatest(-0.3e0, -5.5e0 - lo) + {u(key('global-h', 'record_id'), 0)} * (least(0.3e0, 20e0 - hi) - greatest(-0.3e0, -5.5e0 - lo)) else 0e0 end as offset_ppm from lim)
"""


@query("global_shift", MOVED + "select record_id, round(shift + offset_ppm, 6) as shift from pk join off using (record_id) where nucleus = 'h'")
def global_shift(spark, sf_dir):
    moved = A.global_shift(F.col("h_nmr_peaks"), F.col("record_id"), "h", *H_BIN_RANGE, 0.3, 0.5, SEED)
    rows = exploded(spectra(spark, sf_dir), "record_id", items=moved)
    return rows.select("record_id", F.round("item.shift", 6).alias("shift"))


MASK = RECORDS + f""",
ms as (select record_id, arg_min(i, (-{u(key('mask-c', 'record_id', 'i'))}, i)) as masked from pk where nucleus = 'c' group by 1)
"""


@query("masked_peak", MASK + "select record_id, masked::integer as masked from ms")
def masked_peak(spark, sf_dir):
    masked = A.masked_peak(F.col("c_nmr_peaks"), F.col("record_id"), "c", SEED)
    return spectra(spark, sf_dir).select("record_id", masked.alias("masked")).filter("masked is not null")


@query("local_jitter", MASK + f""",
n as (select pk.record_id, i, shift, i <> masked and {u(key('jitter-c', 'pk.record_id'))} < 0.6 as used,
  sqrt(-2e0 * ln(1e0 - {u(key('noise-c', 'pk.record_id', 'i'), 0)})) * cos(2 * pi() * {u(key('noise-c', 'pk.record_id', 'i'), 1)}) * 1.5e0 as noise
  from pk join ms using (record_id) where nucleus = 'c')
select record_id, i::integer as position, case when used then round(greatest(-40e0, least(300e0, shift + noise)), 5) else greatest(-40e0, least(300e0, shift)) end as shift from n""")
def local_jitter(spark, sf_dir):
    c, record = F.col("c_nmr_peaks"), F.col("record_id")
    staged = spectra(spark, sf_dir).withColumn("masked", A.masked_peak(c, record, "c", SEED))
    moved = A.local_jitter(c, F.col("masked"), record, "c", *C_BIN_RANGE, 1.5, 0.6, SEED)
    clamped = F.transform(c, lambda p: F.greatest(F.lit(C_BIN_RANGE[0]), F.least(F.lit(C_BIN_RANGE[1]), p["shift"])))
    both = F.arrays_zip(F.transform(moved, lambda p: p["shift"]).alias("new"), clamped.alias("old"))
    # unmoved peaks are compared bit by bit, moved ones to five decimals
    shown = F.when(F.col("p.new") == F.col("p.old"), F.col("p.new")).otherwise(F.round("p.new", 5))
    return pos_exploded(staged, "record_id", items=both, name="p").select(
        "record_id", "position", shown.alias("shift"))


@query("masked_annotations", RECORDS + f"""
select record_id, i::integer as position, case when {u(key('annotation', 'record_id'))} >= 0.4 then integration end as integration,
  case when {u(key('annotation', 'record_id', 'i'), 0)} >= 0.4 or mult = '<unk>' then mult end as multiplicity,
  case when {u(key('annotation', 'record_id', 'i'), 1)} >= 0.4 then n_j end::bigint as j_count,
  case when {u(key('annotation', 'record_id', 'i'), 2)} >= 0.4 then half end as half_span from pk where nucleus = 'h'""")
def masked_annotations(spark, sf_dir):
    masked = A.masked_annotations(F.col("h_nmr_peaks"), F.col("record_id"), 0.4, SEED)
    return pos_exploded(spectra(spark, sf_dir), "record_id", items=masked, name="p").select(
        "record_id", "position", "p.integration", "p.multiplicity", F.size("p.j_values").cast("bigint").alias("j_count"),
        F.col("p.range_half_span").alias("half_span"))


@query("dropped_modality", RECORDS + f""",
n as (select record_id, count(*) filter (where nucleus = 'h') as h, count(*) filter (where nucleus = 'c') as c from pk group by 1)
select record_id, case when {u(key('modality', 'record_id'), 1)} < 0.5 then 'h' else 'c' end as dropped from n
where h > 0 and c > 0 and {u(key('modality', 'record_id'), 0)} < 0.3""")
def dropped_modality(spark, sf_dir):
    dropped = A.dropped_modality(F.col("h_nmr_peaks"), F.col("c_nmr_peaks"), F.col("record_id"), 0.3, SEED)
    return spectra(spark, sf_dir).select("record_id", dropped.alias("dropped")).filter("dropped is not null")
