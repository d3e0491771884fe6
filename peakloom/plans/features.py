"""Model input columns and vector features."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from peakloom.functions import model_inputs as I
from peakloom.functions import peaks as P
from peakloom.functions import vectors as V
from peakloom.functions.binding import exploded, pos_exploded
from peakloom.operators import dialects as D
from peakloom.operators.conform import carbon, proton
from peakloom.plans.registry import query
from peakloom.plans.sql import RECORDS
from peakloom.plans.views import spectra, table
from peakloom.schema import MACCS_BITS

FIT = RECORDS + """, over as (select distinct record_id from pk where nucleus = 'h' and n_j > 6
  union select record_id from pk group by record_id, nucleus having count(*) > 60), fit as (select * from pk where record_id not in (select record_id from over))
"""


def _batch(spark, sf_dir):
    """Records inside the size limits, as fixed-width columns."""
    records = spectra(spark, sf_dir).filter(F.size(D.encoder_size_issues()) == 0)
    return records.select("record_id", "h_nmr_peaks", *[c.alias(n) for n, c in I.encoder_columns().items()])


@query("encoder_protons", FIT + """, ids as (select case mult when '<unk>' then 1 when 'm' then 2 when 'd' then 3 when 's' then 4 when 'quint' then 15 when 'sept' then 18 when 'bd' then 21 else 0 end as mid, * from fit where nucleus = 'h')
select record_id, i::integer as position, shift, coalesce(integration, 0)::double as integration, mid::integer as multiplicity, coalesce(n_j, 0)::bigint as j_known,
  round(coalesce(n_j * j_value, 0), 6) as j_sum, coalesce(half, 0) as half_span, (integration is not null)::integer + (mult is not null)::integer * 2 + (n_j is not null)::integer * 4 + (half is not null)::integer * 8 as available
from ids""")
def encoder_protons(spark, sf_dir):
    records = spectra(spark, sf_dir).filter(F.size(D.encoder_size_issues()) == 0)
    rows = pos_exploded(records, "record_id", items=I.proton_inputs(), name="p").filter("p.peak_mask")
    bits = [F.get("p.availability", F.lit(k)).cast("int") * (1 << k) for k in range(4)]
    j_sum = F.aggregate("p.j_values.values", F.lit(0.0), lambda a, v: a + v)
    return rows.select(
        "record_id", "position", F.col("p.shift").alias("shift"), F.col("p.integration").alias("integration"),
        F.col("p.multiplicity").alias("multiplicity"),
        F.size(F.filter("p.j_values.mask", lambda m: m)).cast("bigint").alias("j_known"), F.round(j_sum, 6).alias("j_sum"),
        F.col("p.range_half_span").alias("half_span"), (bits[0] + bits[1] + bits[2] + bits[3]).alias("available"))


@query("encoder_padding", FIT + """
select r.record_id, 60::bigint as h_width, 60::bigint as c_width, count(f.i) filter (where nucleus = 'h') as h_known, count(f.i) filter (where nucleus = 'c') as c_known,
  round(coalesce(sum(shift) filter (where nucleus = 'c'), 0), 10) as c_sum
from recs r left join fit f on f.record_id = r.record_id where r.record_id not in (select record_id from over) group by r.record_id""")
def encoder_padding(spark, sf_dir):
    known = lambda c: F.size(F.filter(c, lambda m: m)).cast("bigint")
    return _batch(spark, sf_dir).select(
        "record_id", F.size("h_shift").cast("bigint").alias("h_width"), F.size("c_shift").cast("bigint").alias("c_width"),
        known("h_peak_mask").alias("h_known"), known("c_peak_mask").alias("c_known"),
        F.round(F.aggregate("c_shift", F.lit(0.0), lambda a, v: a + v), 10).alias("c_sum"))


@query("encoder_rejects_long", """
with p as (select l_partkey as part, count(*) filter (where l_linestatus = 'O') as h, count(*) filter (where l_linestatus <> 'O') as c, max(l_linenumber) as j from lineitem group by 1)
select part, h, c, h <= 60 and c <= 60 and (j <= 6 or h = 0) as accepted, case when h <= 60 and c <= 60 and (j <= 6 or h = 0) then h + c end as known from p""")
def encoder_rejects_long(spark, sf_dir):
    """Long peak and coupling lists: a part's lines as one record, refused beyond the widths, else padded whole."""
    is_h, j = F.col("l_linestatus") == "O", F.array_repeat(F.lit(1.0), F.max("l_linenumber").over(Window.partitionBy("l_partkey")))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.when(is_h, proton(F.col("l_quantity"), j_values=j)).alias("h"),
        F.when(~is_h, carbon(F.col("l_quantity"))).alias("c"))
    records = lines.groupBy(F.col("l_partkey").alias("part")).agg(
        F.collect_list("h").alias("h_nmr_peaks"), F.collect_list("c").alias("c_nmr_peaks"))
    accepted = F.size(D.encoder_size_issues()) == 0
    columns = I.encoder_columns()
    known = sum(F.size(F.filter(columns[m], lambda x: x)) for m in ("h_peak_mask", "c_peak_mask"))
    length = F.size(columns["h_shift"]) + F.size(columns["c_shift"]) - 120
    return records.select(
        "part", F.size("h_nmr_peaks").cast("bigint").alias("h"), F.size("c_nmr_peaks").cast("bigint").alias("c"),
        accepted.alias("accepted"), F.when(accepted, known + length).cast("bigint").alias("known"))


EXPANDABLE = RECORDS + """, bad as (select distinct record_id from pk where nucleus = 'h' and (n_members = 0 or (n_members is null and not coalesce(integration > 0, false)))),
e as (select *, case when n_members = 2 then 2 else integration end as copies from pk where nucleus = 'h' and record_id not in (select record_id from bad)),
eh as (select record_id, sum(copies)::bigint as n_h, sum(case when n_members = 2 then (shift - 0.5e0) + (shift + 0.5e0) else shift * integration end) as s_h from e group by 1),
ec as (select record_id, count(*) as n_c, sum(shift) as s_c from pk where nucleus = 'c' group by 1)
"""


def _expandable(spark, sf_dir):
    """Records whose proton peaks can all be expanded to atoms."""
    empty_members = P.any_peak(F.col("h_nmr_peaks"), lambda p: F.size(p["member_shifts"]) == 0)
    no_expansion = P.any_peak(F.col("h_nmr_peaks"), lambda p: p["member_shifts"].isNull() & F.coalesce(p["integration"] <= 0, F.lit(True)))
    return spectra(spark, sf_dir).filter(~empty_members & ~no_expansion)


@query("expanded_protons", EXPANDABLE + "select record_id, n_h as protons, round(s_h, 6) as shift_sum from eh")
def expanded_protons(spark, sf_dir):
    shifts = _expandable(spark, sf_dir).select("record_id", P.expanded_proton_shifts(F.col("h_nmr_peaks")).alias("s"))
    return shifts.filter(F.size("s") > 0).select(
        "record_id", F.size("s").cast("bigint").alias("protons"),
        F.round(F.aggregate("s", F.lit(0.0), lambda a, v: a + v), 6).alias("shift_sum"))


@query("sequence_features", EXPANDABLE + """, w as (
  select max(coalesce(n_h, 0) + coalesce(n_c, 0)) as width from recs left join eh using (record_id) left join ec using (record_id) where record_id not in (select record_id from bad))
select r.record_id, coalesce(n_h, 0) + coalesce(n_c, 0) as length, round(coalesce(s_h, 0) + coalesce(s_c, 0), 10) as shift_sum, coalesce(n_h, 0)::double as count_sum,
  coalesce(n_c, 0) as carbons, width - coalesce(n_h, 0) - coalesce(n_c, 0) as padding
from w, recs r left join eh using (record_id) left join ec using (record_id)
where r.record_id not in (select record_id from bad)""")
def sequence_features(spark, sf_dir):
    """Padded to the longest sequence of the table."""
    records = _expandable(spark, sf_dir)
    width = records.agg(F.max(I.sequence_columns(0)["sequence_length"])).first()[0] or 0
    wide = records.select("record_id", *[c.alias(n) for n, c in I.sequence_columns(width).items()])
    total = lambda c, zero: F.aggregate(c, zero, lambda a, v: a + v)
    return wide.select(
        "record_id", F.col("sequence_length").cast("bigint").alias("length"), F.round(total("shifts", F.lit(0.0)), 10).alias("shift_sum"),
        total("counts", F.lit(0.0)).alias("count_sum"), total("types", F.lit(0)).cast("bigint").alias("carbons"),
        F.size(F.filter("padding_mask", lambda m: m)).cast("bigint").alias("padding"))


RANGED_OK = RECORDS + """, bad as (select distinct record_id from pk where nucleus = 'h' and (not coalesce(integration between 1 and 50, false) or mult is null or n_j is null or range_min is null or range_max is null)),
okr as (select * from pk where nucleus = 'h' and record_id not in (select record_id from bad) and record_id in (select record_id from pk where nucleus = 'c'))
"""


@query("ranged_fields", RANGED_OK + """
select record_id, shift as "centroid", range_min as "rangeMin", range_max as "rangeMax", case mult when 'quint' then 'p' when 'sept' then 'hept' when 'bd' then 'brd' else mult end as category,
  integration::integer as "nH", case when n_j = 0 then 0 else n_j end::bigint as j_parts from okr""")
def ranged_fields(spark, sf_dir):
    good = spectra(spark, sf_dir).filter(F.size(D.dialect_issues("ranged", strict=False)) == 0)
    rows = exploded(good, "record_id", items=I.ranged_protons(F.col("h_nmr_peaks"))).select("record_id", "item.*")
    parts = F.when(F.col("j_values") == "_", 0).otherwise(F.size(F.split("j_values", "_")))
    return rows.withColumn("j_parts", parts.cast("bigint")).drop("j_values")


@query("ranged_native_labels", RANGED_OK + """select record_id, mraw as category, count(*) as n from okr group by all""")
def ranged_native_labels(spark, sf_dir):
    good = spectra(spark, sf_dir).filter(F.size(D.dialect_issues("ranged", native=True, strict=False)) == 0)
    rows = exploded(good, "record_id", items=I.ranged_protons(F.col("h_nmr_peaks"), native=True)).select("record_id", "item.*")
    return rows.groupBy("record_id", "category").agg(F.count("*").alias("n"))


TOK_OK = RECORDS + """, bad as (select distinct record_id from pk where nucleus = 'h' and (not coalesce(integration > 0, false) or mult is null or n_j is null or n_j > 6
  or (half is null and (range_min is null or range_max is null)))),
okt as (select * from pk where record_id not in (select record_id from bad) and record_id in (select record_id from pk where nucleus = 'c') and record_id in (select record_id from pk where nucleus = 'h'))
"""


@query("tokenised_text", TOK_OK + """
select record_id, count(*) filter (where nucleus = 'h') as protons, count(*) filter (where nucleus = 'c') as carbons,
  sum(shift) filter (where nucleus = 'h') as h_sum, sum(coalesce(half, (range_max - range_min) / 2e0)) filter (where nucleus = 'h') as half_sum,
  sum(integration) filter (where nucleus = 'h')::bigint as integration_sum, round(sum(n_j * j_value) filter (where nucleus = 'h'), 6) as j_sum,
  min(mult) filter (where nucleus = 'h') as first_label from okt group by record_id""")
def tokenised_text(spark, sf_dir):
    """Written as JSON text and read back with an independent schema."""
    good = spectra(spark, sf_dir).filter(F.size(D.dialect_issues("tokenised", strict=False)) == 0)
    texts = good.select("record_id", I.tokenised_json(F.col("h_nmr_peaks"), F.col("c_nmr_peaks")).alias("t"))
    parsed = texts.select("record_id", F.from_json("t", "`1HNMR` array<string>, `13CNMR` array<double>").alias("s")).select(
        "record_id", F.transform(F.col("s")["1HNMR"], lambda p: F.from_json(p, "array<string>")).alias("h"), F.col("s")["13CNMR"].alias("c"))
    total = lambda f: F.aggregate(F.transform("h", f), F.lit(0.0), lambda a, v: a + v)
    j_total = lambda p: F.aggregate(F.from_json(p[4], "array<double>"), F.lit(0.0), lambda a, v: a + v)
    return parsed.select(
        "record_id", F.size("h").cast("bigint").alias("protons"), F.size("c").cast("bigint").alias("carbons"),
        total(lambda p: p[0].cast("double")).alias("h_sum"), total(lambda p: p[1].cast("double")).alias("half_sum"),
        total(lambda p: F.rtrim(p[3], F.lit("H")).cast("double")).cast("bigint").alias("integration_sum"),
        F.round(total(j_total), 6).alias("j_sum"), F.array_min(F.transform("h", lambda p: p[2])).alias("first_label"))


@query("scaled_carbons", RECORDS + "select record_id, greatest(0e0, least(1e0, shift / 220e0)) as scaled from pk where nucleus = 'c'")
def scaled_carbons(spark, sf_dir):
    return exploded(spectra(spark, sf_dir), "record_id", items=I.scaled_carbon(F.col("c_nmr_peaks")), name="scaled")


@query("multiplicity_ids", """
with m as (select distinct case l_linenumber when 1 then 's' when 2 then 'd' when 3 then 'quint' when 4 then 'dqd' when 5 then '<unk>' when 6 then 'm' end as label from lineitem)
select label, case label when 's' then 4 when 'd' then 3 when 'quint' then 15 when 'dqd' then 22 when '<unk>' then 1 when 'm' then 2 else 0 end::integer as model_id,
  case label when 's' then 3 when 'd' then 2 when 'quint' then 14 when 'dqd' then 21 when '<unk>' then 0 when 'm' then 1 end::integer as tokenised_index, label as back from m""")
def multiplicity_ids(spark, sf_dir):
    names = {1: "s", 2: "d", 3: "quint", 4: "dqd", 5: "<unk>", 6: "m"}
    line = F.col("l_linenumber")
    label = F.coalesce(*[F.when(line == k, F.lit(v)) for k, v in names.items()])
    rows = table(spark, sf_dir, "lineitem").select(label.alias("label")).distinct()
    number = I.multiplicity_id(F.col("label"))
    return rows.select("label", number.alias("model_id"), I.tokenised_index(F.col("label")).alias("tokenised_index"),
                       I.multiplicity_label(number).alias("back"))


@query("rbf_expansion", """
select l_returnflag as flag, k::integer as centre, round(sum(exp(-0.5e0 * ((l_quantity - (0e0 + k * (50e0 / 7e0))) / 4e0) ** 2)), 4) as activation
from lineitem, (select unnest(range(8)) as k) group by all""")
def rbf_expansion(spark, sf_dir):
    flag = F.col("l_returnflag").alias("flag")
    rows = pos_exploded(table(spark, sf_dir, "lineitem"), flag, items=V.rbf_expansion(F.col("l_quantity"), 0.0, 50.0, 8, 4.0), pos="centre", name="v")
    return rows.groupBy("flag", "centre").agg(F.round(F.sum("v"), 4).alias("activation"))


@query("soft_label_bins", """
with x as (select l_returnflag as flag, l_quantity, k, exp(-0.5e0 * ((l_quantity - k * 10e0) / 3e0) ** 2) as e, row_number() over () as rid from lineitem, (select unnest(range(6)) as k)),
r as (select l_orderkey, l_returnflag as flag, l_quantity as q,
  (select sum(exp(-0.5e0 * ((l_quantity - k * 10e0) / 3e0) ** 2)) from (select unnest(range(6)) as k)) as t from lineitem)
select flag, k::integer as bin, round(sum(exp(-0.5e0 * ((q - k * 10e0) / 3e0) ** 2) / greatest(t, 1e-12)), 4) as mass from r, (select unnest(range(6)) as k) group by all""")
def soft_label_bins(spark, sf_dir):
    flag = F.col("l_returnflag").alias("flag")
    rows = pos_exploded(table(spark, sf_dir, "lineitem"), flag, items=V.soft_bins(F.col("l_quantity"), 0.0, 50.0, 6, 3.0), pos="bin", name="v")
    return rows.groupBy("flag", "bin").agg(F.round(F.sum("v"), 4).alias("mass"))


@query("value_bins", """
select least(greatest(cast(trunc((l_quantity - 5e0) / 2.5e0) as integer), 0), 9) as bin, count(*) as n,
  round(sum([1e0, 2e0, 5e0, 10e0, 20e0][least(cast(trunc(l_quantity / 50e0 / 0.2e0) as integer), 4) + 1]), 4) as weight from lineitem group by 1""")
def value_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        V.bin_index(F.col("l_quantity"), 5.0, 2.5, 10).alias("bin"), V.similarity_weight(F.col("l_quantity") / 50.0).alias("w"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("weight"))


@query("unpacked_bits", """
with b as (select vec_id, range as i, (vec_id * 7 + range * 13) % 251 as byte from embeddings, range(256))
select vec_id, count(*) as ones, sum((i * 8 + k) * (i * 8 + k + 1))::bigint as places from b, (select unnest(range(8)) as k) where (byte >> k) & 1 = 1 group by vec_id""")
def unpacked_bits(spark, sf_dir):
    pairs = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.lpad(F.hex((F.col("vec_id") * 7 + i * 13) % 251), 2, "0"))
    packed = F.unhex(F.array_join(pairs, ""))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.unpack_bits(packed, 256).alias("bits"))
    ones = pos_exploded(rows, "vec_id", items="bits", name="bit").filter("bit = 1")
    place = F.col("position").cast("bigint")
    return ones.groupBy("vec_id").agg(F.count("*").alias("ones"), F.sum(place * (place + 1)).alias("places"))


@query("bit_text", """
with t as (select doc_id, case when doc_id % 9 = 0 then '012' else lpad(bin(n_chars), 166, '0') end as s from documents)
select doc_id, case when doc_id % 9 = 0 then null else len(replace(s, '0', '')) end as ones from t""")
def bit_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 9 == 0, "012").otherwise(F.lpad(F.bin("n_chars"), MACCS_BITS, "0")).alias("s"))
    bits = V.bits_from_text(F.col("s"), MACCS_BITS)
    return rows.select("doc_id", F.aggregate(bits, F.lit(0), lambda a, b: a + b).cast("bigint").alias("ones"))
