"""Landing tables of five source shapes brought into the canonical schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions import text as X
from peakloom.functions.binding import exploded
from peakloom.functions.peaks import any_peak
from peakloom.operators import conform as C
from peakloom.plans.registry import query
from peakloom.plans.sql import LINE_PEAKS
from peakloom.plans.views import collected, line_peaks, table

ORDER_SQL = "with " + LINE_PEAKS + """,
o as (select ok, source, mol_key, case when ok % 10 = 0 then 'test' else 'train' end as split from recs where not is_dup)
"""


def _orders(spark, sf_dir):
    ok = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        ok.alias("ok"), F.when(ok % 10 == 0, "test").otherwise("train").alias("split"),
        F.concat(F.lit(" M"), (F.col("o_custkey") % 50).cast("string"), F.lit(" ")).alias("structure"),
        F.col("o_custkey").alias("cust"))


def _peak_lists(flat, h, c):
    return collected(flat, "ok", h, c)


def rich_landing(spark, sf_dir) -> DataFrame:
    """Text fields as such a release writes them, with some unreadable places."""
    flat, line, defect = line_peaks(spark, sf_dir, by_order=True), F.col("line_no"), F.col("defect")
    text = F.col("shift").cast("string")
    ranged = line.isin(2, 7)
    h = F.struct(
        F.when(~line.isin(1, 7), text).alias("centroid"),
        F.when(line == 1, text).alias("delta"),
        F.when(ranged, (F.col("shift") - F.col("w")).cast("string")).alias("range_min"),
        F.when(ranged & (defect != 0), (F.col("shift") + F.col("w")).cast("string")).alias("range_max"),
        F.col("mraw").alias("category"),
        F.when(defect == 2, "x").when(line == 4, "").otherwise(F.concat(F.col("integration").cast("string"), F.lit(".0 H"))).alias("n_h"),
        F.when(defect == 3, "abc").when(line == 6, "_").otherwise(F.array_join(F.transform("j_values", lambda j: j.cast("string")), "_")).alias("j_values"),
        F.col("eq_class").cast("string").alias("note"),
    )
    c = F.struct(
        text.alias("delta_ppm"), F.col("integral").cast("string").alias("integral"),
        F.when(defect == 4, "n/a").otherwise(F.col("intensity").cast("string")).alias("intensity"),
        F.col("width").cast("string").alias("width_ppm"))
    blank = F.col("cust") % 7
    return _orders(spark, sf_dir).join(_peak_lists(flat, h, c), "ok", "left").select(
        F.col("ok").cast("string").alias("key"), "split",
        F.when(blank == 0, F.lit("  ")).otherwise(F.col("structure")).alias("smiles"),
        F.when(blank < 2, F.when(F.col("cust") % 3 == 0, None).otherwise(F.concat(F.lit("c"), F.trim("structure")))).alias("smiles_canonical"),
        F.when(F.col("cust") % 2 == 0, F.lit("400.13")).alias("nmr_frequency"), F.lit(" CDCl3 ").alias("nmr_solvent"),
        "h_peaks", "c_peaks")


RICH_SQL = ORDER_SQL + """,
s as (select ok, 'lit:' || split || ':' || ok as record_id, o_custkey % 7 as blank, o_custkey % 3 as third, mol_key from o join orders on ok = o_orderkey),
st as (select ok, record_id, case when blank <> 0 then mol_key when third <> 0 then 'c' || mol_key end as smiles from s),
hp as (select st.record_id, lp.*, line_no in (2, 7) as ranged, line_no in (2, 7) and defect = 0 as half_range from st join lp on st.ok = lp.ok where nucleus = 'h'),
issues as (
  select record_id, 'missing_structure' as code from st where smiles is null
  union all select record_id, 'incomplete_range' from hp where half_range
  union all select record_id, 'invalid_integration' from hp where defect = 2
  union all select record_id, 'invalid_j_values' from hp where defect = 3)
"""


@query("conform_rich_peaks", RICH_SQL + """,
v as (select record_id, line_no, case when line_no = 7 and defect = 0 then null else shift end as shift,
    case when ranged then shift - w when line_no = 7 then null else shift end as lo,
    case when ranged and defect <> 0 then shift + w when line_no = 7 then null else shift end as hi,
    case when defect = 2 or line_no = 4 then null else integration end as integration, mtrim, mult,
    case when defect = 3 or line_no = 6 or n_j is null then 0 else n_j end as n_j from hp)
select record_id, shift, integration, mtrim as multiplicity_raw, mult as multiplicity, n_j::bigint as j_count, lo as range_min, hi as range_max,
  (hi - lo) / 2e0 as range_half_span from v""")
def conform_rich_peaks(spark, sf_dir):
    records = C.conform_rich(rich_landing(spark, sf_dir), "literature", "lit", keep_carbon_properties=False)
    return exploded(records, "record_id", items="h_nmr_peaks").select("record_id", "item.*").select(
        "record_id", "shift", "integration", "multiplicity_raw", "multiplicity",
        F.size("j_values").cast("bigint").alias("j_count"), "range_min", "range_max", "range_half_span")


@query("conform_rich_records", RICH_SQL + """
select record_id, 'literature' as source, smiles, case when o_custkey % 2 = 0 then '400.13' end as nmr_frequency, 'CDCl3' as nmr_solvent,
  (select count(*) from issues i where i.record_id = st.record_id) as issues from st join orders on ok = o_orderkey""")
def conform_rich_records(spark, sf_dir):
    records = C.conform_rich(rich_landing(spark, sf_dir), "literature", "lit", keep_carbon_properties=False)
    return records.select("record_id", "source", "smiles", "nmr_frequency", "nmr_solvent",
                          F.size("conform_issues").cast("bigint").alias("issues"))


@query("conform_rich_issues", RICH_SQL + "select code, count(*) as n from issues group by code")
def conform_rich_issues(spark, sf_dir):
    records = C.conform_rich(rich_landing(spark, sf_dir), "literature", "lit", keep_carbon_properties=False)
    return exploded(records, items="conform_issues").groupBy(F.col("item.code").alias("code")).agg(F.count("*").alias("n"))


@query("conform_simulated_carbons", RICH_SQL + """
select 'sim:' || split || ':' || o.ok as record_id, shift, integral, case when defect = 4 then null else intensity end as intensity, width
from o join lp on o.ok = lp.ok where nucleus = 'c'""")
def conform_simulated_carbons(spark, sf_dir):
    records = C.conform_rich(rich_landing(spark, sf_dir), "simulated", "sim", keep_carbon_properties=True)
    return exploded(records, "record_id", items="c_nmr_peaks").select("record_id", "item.*")


def tokenised_landing(spark, sf_dir) -> DataFrame:
    """JSON texts with five-part proton tuples."""
    flat, line, defect = line_peaks(spark, sf_dir, by_order=True), F.col("line_no"), F.col("defect")
    j = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("j_values", lambda x: x.cast("string")), ","), F.lit("")), F.lit("]"))
    label = F.coalesce(F.concat(F.lit('"'), F.col("mraw"), F.lit('"')), F.lit("null"))
    half = F.when(line == 3, "null").when(defect == 1, "-0.5").otherwise(F.col("w").cast("string"))
    full = F.concat_ws(",", F.col("shift").cast("string"), half, label,
                       F.concat(F.lit('"'), F.coalesce(F.col("integration").cast("string"), F.lit("")), F.lit('"')), j)
    short = F.concat_ws(",", F.col("shift").cast("string"), half)
    h = F.concat(F.lit("["), F.when(defect == 2, short).otherwise(full), F.lit("]"))
    lists = _peak_lists(flat, h, F.col("shift").cast("string"))
    null_c = F.col("cust") % 9 == 0
    body = F.concat(
        F.lit('{"1HNMR":['), F.array_join(F.coalesce("h_peaks", F.array()), ","), F.lit("]"),
        F.when(null_c, F.lit("")).otherwise(
            F.concat(F.lit(',"13CNMR":['), F.array_join(F.coalesce("c_peaks", F.array()), ","), F.lit("]"))), F.lit("}"))
    return _orders(spark, sf_dir).join(lists, "ok", "left").select(
        F.when(F.col("cust") % 4 != 0, F.col("cust")).alias("id"), F.col("ok").alias("row_index"), "split",
        F.when(F.col("cust") % 2 == 0, F.col("structure")).alias("original_smiles"),
        F.col("structure").alias("smiles"),
        F.when(F.col("cust") % 101 == 0, F.lit("{broken")).otherwise(body).alias("tokenized_input"))


TOK_SQL = ORDER_SQL + """,
t as (select o.ok, o_custkey as cust, 'tok:' || split || ':' || case when o_custkey % 4 = 0 then 'row-' || ok else o_custkey::varchar end || ':row-' || ok as record_id
  from o join orders on ok = o_orderkey),
good as (select * from t where cust % 101 <> 0)
"""


@query("conform_tokenised_protons", TOK_SQL + """
select record_id, shift, case when defect = 2 then null else integration end as integration,
  case when defect = 2 then null else mtrim end as multiplicity_raw, case when defect = 2 then null else mult end as multiplicity,
  case when defect = 2 then 0 else coalesce(n_j, 0) end::bigint as j_count,
  case when line_no = 3 then null when defect = 1 then -0.5e0 else w end as range_half_span,
  case when line_no = 3 then null when defect = 1 then shift - 0.5e0 else shift + w end as range_max
from good join lp using (ok) where nucleus = 'h'""")
def conform_tokenised_protons(spark, sf_dir):
    records = C.conform_tokenised(tokenised_landing(spark, sf_dir), "tokenised", "tok")
    return exploded(records, "record_id", items="h_nmr_peaks").select("record_id", "item.*").select(
        "record_id", "shift", "integration", "multiplicity_raw", "multiplicity",
        F.size("j_values").cast("bigint").alias("j_count"), "range_half_span", "range_max")


@query("conform_tokenised_issues", TOK_SQL + """
select code, count(*) as n from (
  select 'invalid_json' as code from t where cust % 101 = 0
  union all select 'incomplete_peak' from good join lp using (ok) where nucleus = 'h' and defect = 2
  union all select 'negative_half_span' from good join lp using (ok) where nucleus = 'h' and defect = 1 and line_no <> 3) group by code""")
def conform_tokenised_issues(spark, sf_dir):
    records = C.conform_tokenised(tokenised_landing(spark, sf_dir), "tokenised", "tok")
    return exploded(records, items="conform_issues").groupBy(F.col("item.code").alias("code")).agg(F.count("*").alias("n"))


@query("conform_tokenised_carbons", TOK_SQL + """select record_id, shift from good join lp using (ok) where nucleus = 'c' and cust % 9 <> 0""")
def conform_tokenised_carbons(spark, sf_dir):
    records = C.conform_tokenised(tokenised_landing(spark, sf_dir), "tokenised", "tok")
    return exploded(records, "record_id", items="c_nmr_peaks").select("record_id", "item.*").select("record_id", "shift")


def atom_landing(spark, sf_dir) -> DataFrame:
    """Parallel atom arrays: hydrogens, carbons and some oxygens."""
    flat = line_peaks(spark, sf_dir, by_order=True)
    number = F.when(F.col("line_no") == 7, 8).when(F.col("nucleus") == "h", 1).otherwise(6)
    atom = F.struct(F.col("w"), F.col("shift"), number.alias("z"), F.col("eq_class").alias("k"), F.col("integral"), F.col("width"), F.col("defect"))
    grouped = flat.select("ok", atom.alias("atom")).groupBy("ok").agg(F.sort_array(F.collect_list("atom")).alias("a"))
    empty = F.array().cast("array<struct<w:double,shift:double,z:int,k:bigint,integral:double,width:double,defect:bigint>>")
    atoms = F.coalesce("a", empty)
    k = F.transform(atoms, lambda a: a["k"])
    return _orders(spark, sf_dir).join(grouped, "ok", "left").select(
        F.when(F.col("ok") % 20 == 0, F.unhex(F.lit("FF00"))).when(F.col("ok") % 20 == 1, F.to_binary(F.lit(""), F.lit("utf-8")))
        .otherwise(F.to_binary(F.col("ok").cast("string"), F.lit("utf-8"))).alias("key"),
        F.when(F.col("cust") % 5 != 0, F.col("structure")).alias("smiles"),
        F.when(F.col("cust") % 10 == 0, F.col("structure")).alias("canonical_smiles"),
        F.transform(atoms, lambda a: a["shift"]).alias("shifts"),
        F.transform(atoms, lambda a: a["z"]).alias("atom_numbers"),
        F.when(F.col("cust") % 103 == 0, F.concat(k, F.array(F.lit(0).cast("bigint")))).otherwise(k).alias("equivalence_classes"),
        "ok")


ATOM_SQL = ORDER_SQL + """,
t as (select ok, o_custkey as cust, mol_key, 'atoms:' || case when ok % 20 = 0 then 'ff00' when ok % 20 = 1 then '' else ok::varchar end as record_id
  from o join orders on ok = o_orderkey),
a as (select t.*, shift, eq_class, nucleus, line_no from t join lp using (ok) where line_no <> 7)
"""


@query("conform_atom_peaks", ATOM_SQL + """
select record_id, nucleus, eq_class as equivalence_class, count(*) as members, round(avg(shift), 6) as shift, ok from a where nucleus = 'h' and cust % 103 <> 0 group by all""")
def conform_atom_peaks(spark, sf_dir):
    landing = atom_landing(spark, sf_dir)
    # the arrays of a record carry no order key, so the landing key column rides along
    keyed = C.conform_atoms(landing.withColumn("smiles", F.concat_ws("|", F.coalesce("smiles", "canonical_smiles", F.lit("")), F.col("ok").cast("string"))), "atoms", "atoms")
    good = keyed.filter(~any_peak(F.col("conform_issues"), lambda x: x["code"] == "length_mismatch"))
    order = F.split_part("smiles", F.lit("|"), F.lit(2)).cast("bigint").alias("ok")
    return exploded(good, "record_id", order, items="h_nmr_peaks").select("record_id", "ok", "item.*").select(
        "record_id", F.lit("h").alias("nucleus"), "equivalence_class", F.col("integration").alias("members"),
        F.round("shift", 6).alias("shift"), "ok")


@query("conform_atom_carbons", ATOM_SQL + """
, g as (select ok, eq_class, avg(shift) as shift from a where nucleus = 'c' group by 1, 2)
select count(*) as peaks, round(sum(shift), 3) as shift_sum, (select count(*) from t where cust % 103 = 0) as mismatched from g""")
def conform_atom_carbons(spark, sf_dir):
    records = C.conform_atoms(atom_landing(spark, sf_dir), "atoms", "atoms")
    shifts = F.transform("c_nmr_peaks", lambda p: p["shift"])
    return records.agg(
        F.sum(F.size("c_nmr_peaks")).alias("peaks"),
        F.round(F.sum(F.aggregate(shifts, F.lit(0.0), lambda a, v: a + v)), 3).alias("shift_sum"),
        F.count_if(any_peak(F.col("conform_issues"), lambda x: x["code"] == "length_mismatch")).alias("mismatched"))


@query("conform_atom_routing", ATOM_SQL + """
select 'accepted' as side, record_id, null as reason from t where cust % 103 <> 0 and (cust % 5 <> 0 or cust % 10 = 0)
union all select 'rejected', record_id, 'missing_structure' from t where cust % 103 <> 0 and cust % 5 = 0 and cust % 10 <> 0""")
def conform_atom_routing(spark, sf_dir):
    landing = atom_landing(spark, sf_dir).filter(F.size("shifts") == F.size("equivalence_classes"))
    rows = C.routed(C.conform_atoms(landing, "atoms", "atoms"))
    side = F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    return rows.select(side.alias("side"), "record_id", "reason")


@query("conform_shift_lists", ORDER_SQL + """
select 'plain:' || split || ':' || o.ok as record_id, nucleus, shift from o join lp on o.ok = lp.ok""")
def conform_shift_lists(spark, sf_dir):
    lists = _peak_lists(line_peaks(spark, sf_dir, by_order=True), F.col("shift"), F.col("shift"))
    landing = _orders(spark, sf_dir).join(lists, "ok", "left").select(
        "split", F.col("ok").alias("row_index"), F.col("structure").alias("smiles"),
        F.col("h_peaks").alias("h_shift"), F.col("c_peaks").alias("c_shift"))
    records = C.conform_shifts(landing, "plain", "plain")
    def tagged(nucleus):
        return F.transform(f"{nucleus}_nmr_peaks", lambda p: F.struct(F.lit(nucleus).alias("nucleus"), p["shift"].alias("shift")))

    return exploded(records, "record_id", items=F.concat(tagged("h"), tagged("c"))).select("record_id", "item.*")


@query("json_text_numbers", """select event_type, count(*) as n, sum((props->>'k')::bigint)::bigint as total from events group by event_type""")
def json_text_numbers(spark, sf_dir):
    parsed = F.from_json("props", "k string")["k"]
    return table(spark, sf_dir, "events").select("event_type", X.non_negative_integer(parsed).alias("k")).groupBy(
        "event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))
