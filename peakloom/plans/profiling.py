"""Inventories, summaries, distributions and reconciliations."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.functions.text import display_name
from peakloom.operators import profile as P
from peakloom.plans.registry import query
from peakloom.plans.sql import DOCS, RECORDS, SCORES
from peakloom.plans.views import line_peaks, order_copies, prop_labels, scores, spectra, table

PER_RECORD = RECORDS + """,
pc as (select record_id, count(*) filter (where nucleus = 'h') as n_h, count(*) filter (where nucleus = 'c') as n_c from pk group by 1),
rs as (select r.*, coalesce(n_h, 0) as n_h, coalesce(n_c, 0) as n_c from recs r left join pc on r.record_id = pc.record_id)
"""
COUNTS = """count(*) as records, count(distinct mol_key) as unique_keys, count(*) filter (where n_h > 0) as records_with_h,
count(*) filter (where n_c > 0) as records_with_c, count(*) filter (where n_h > 0 and n_c > 0) as records_with_h_and_c"""


def rounded(df, digits=6):
    """Doubles rounded, so that the order of a parallel sum does not show."""
    return df.select(*[
        (F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`").alias(c)) for c, t in df.dtypes
    ])


@query("inventory_by_source", PER_RECORD + f"""
select coalesce(source, 'ALL') as source, {COUNTS} from rs group by rollup (source)""")
def inventory_by_source(spark, sf_dir):
    return P.inventory(spectra(spark, sf_dir))


@query("inventory_approximate", PER_RECORD + """
select source, count(*) as records, count(*) filter (where n_h > 0) as records_with_h,
  count(*) filter (where n_c > 0) as records_with_c, count(*) filter (where n_h > 0 and n_c > 0) as records_with_h_and_c,
  true as within_five_percent from rs group by source""")
def inventory_approximate(spark, sf_dir):
    records = spectra(spark, sf_dir)
    exact = records.groupBy("source").agg(F.count_distinct("smiles_canonical").alias("n"))
    near = F.abs(F.col("approx_unique_keys") - F.col("n")) <= 0.05 * F.col("n")
    return P.approximate_inventory(records).join(exact, "source").withColumn(
        "within_five_percent", near).drop("approx_unique_keys", "n")


STATS = ("n_h_peaks", "n_c_peaks", "h_peaks_per_atom", "c_peaks_per_atom")
_SUMMARY = ", ".join(
    f"round(avg({c}), 6) as {c}_mean, round(stddev_samp({c}), 6) as {c}_std, "
    + (f"min({c}) as {c}_min, max({c}) as {c}_max" if c.startswith("n_") else f"round(min({c}), 6) as {c}_min, round(max({c}), 6) as {c}_max")
    for c in STATS
)
STATS_SQL = PER_RECORD + """,
st as (select *, n_h as n_h_peaks, n_c as n_c_peaks, case when n_atoms > 0 then n_h / n_atoms::double end as h_peaks_per_atom,
  case when n_atoms > 0 then n_c / n_atoms::double end as c_peaks_per_atom from rs)
"""


@query("record_numeric_summary", STATS_SQL + f"select source, {_SUMMARY} from st group by source")
def record_numeric_summary(spark, sf_dir):
    stats = P.record_statistics(spectra(spark, sf_dir))
    return rounded(P.numeric_summary(stats, ["source"], list(STATS)))


@query("flag_prevalence", SCORES + """select lang, round(avg(quality), 6) as quality, round(avg(toxic), 6) as toxic from sc group by lang""")
def flag_prevalence(spark, sf_dir):
    return rounded(P.prevalence(scores(spark, sf_dir), ["lang"], ["quality", "toxic"]))


def _peak_sql(name, unit, expr):
    return (f"round(avg({expr}), 6) as {name}_mean{unit}, round(stddev_samp({expr}), 6) as {name}_std{unit}, "
            f"round(min({expr}), 6) as {name}_min{unit}, round(max({expr}), 6) as {name}_max{unit}")


PEAK_SUMMARY = STATS_SQL + f""",
rec_sum as (select source, count(*) as records, {_SUMMARY} from st group by source),
h_sum as (select source, count(*) as h_total_peaks, {_peak_sql('h_shift', '_ppm', 'shift')} from pk where nucleus = 'h' group by source),
c_sum as (select source, count(*) as c_total_peaks, {_peak_sql('c_shift', '_ppm', 'shift')} from pk where nucleus = 'c' group by source),
j_long as (select source, unnest(list_transform(range(n_j), lambda x: j_value)) as j from pk where nucleus = 'h' and n_j > 0),
j_sum as (select source, count(*) as j_value_count, {_peak_sql('j', '_hz', 'j')} from j_long group by source)
"""


@query("peak_summary", PEAK_SUMMARY + """
select * from rec_sum left join h_sum using (source) left join c_sum using (source) left join j_sum using (source)""")
def peak_summary(spark, sf_dir):
    return rounded(P.peak_summary(spectra(spark, sf_dir)))


@query("peak_summary_shift_only", PEAK_SUMMARY + """
select rec_sum.*, h_sum.* exclude (source), c_sum.* exclude (source), cast(null as bigint) as j_value_count,
  cast(null as double) as j_mean_hz, cast(null as double) as j_std_hz, cast(null as double) as j_min_hz, cast(null as double) as j_max_hz
from rec_sum left join h_sum using (source) left join c_sum using (source)""")
def peak_summary_shift_only(spark, sf_dir):
    return rounded(P.peak_summary(spectra(spark, sf_dir), shift_only=True))


@query("annotation_completeness", RECORDS + """
select source, count(*) as h_total_peaks, count(*) filter (where integration is null) as integration_null,
  count(*) filter (where mult is null) as multiplicity_null, count(*) filter (where range_min is null) as range_min_null,
  count(*) filter (where range_max is null) as range_max_null, count(*) filter (where half is null) as range_half_span_null,
  count(*) filter (where n_j is null) as j_values_null, count(*) filter (where integration = 0) as integration_zero,
  count(*) filter (where n_j = 0) as j_values_empty
from pk where nucleus = 'h' group by source""")
def annotation_completeness(spark, sf_dir):
    return P.annotation_completeness(spectra(spark, sf_dir))


DISTRIBUTION = RECORDS + """,
dist as (
  select source, coalesce(mult, '<missing>') as multiplicity, count(*) as n_peaks,
    count(*) / sum(count(*)) over (partition by source) as fraction
  from pk where nucleus = 'h' group by 1, 2)
"""


def _distribution(spark, sf_dir):
    return P.label_distribution(P.proton_rows(spectra(spark, sf_dir), "source"), "source", "multiplicity")


@query("multiplicity_distribution", DISTRIBUTION + "select source, multiplicity, n_peaks, round(fraction, 6) as fraction from dist")
def multiplicity_distribution(spark, sf_dir):
    return rounded(_distribution(spark, sf_dir)).orderBy("source", F.desc("n_peaks"), "multiplicity")


TOP_K = 3


@query("multiplicity_top_pivot", DISTRIBUTION + f""",
top as (select multiplicity, row_number() over (order by sum(n_peaks) desc, multiplicity) as k from dist group by 1),
f as (select source, coalesce(case when k <= {TOP_K} then k end, 0) as k, fraction from dist join top using (multiplicity))
select source, round(coalesce(sum(fraction) filter (where k = 1), 0), 6) as top_1, round(coalesce(sum(fraction) filter (where k = 2), 0), 6) as top_2,
  round(coalesce(sum(fraction) filter (where k = 3), 0), 6) as top_3, round(coalesce(sum(fraction) filter (where k = 0), 0), 6) as other
from f group by source""")
def multiplicity_top_pivot(spark, sf_dir):
    distribution = _distribution(spark, sf_dir)
    top = P.top_labels(distribution, "multiplicity", TOP_K)
    wide = P.pivot_top_labels(distribution, distribution, "source", "multiplicity", top)
    names = {label: f"top_{i}" for i, label in enumerate(top, 1)}
    return rounded(wide.withColumnsRenamed(names))


COHORTS = RECORDS + """,
pc as (select record_id, count(*) filter (where nucleus = 'h') as n_h, count(*) filter (where nucleus = 'c') as n_c from pk group by 1),
rs as (select r.*, case when ok % 3 = 0 then 'toxicity' else 'logp' end as endpoint, case when ok % 5 = 0 then 'test' else 'train_val' end as split,
  coalesce(n_h, 0) as n_h, coalesce(n_c, 0) as n_c from recs r left join pc on r.record_id = pc.record_id)
"""


def _cohort_records(spark, sf_dir):
    ok = F.split_part("record_id", F.lit("-"), F.lit(2)).cast("bigint")
    return spectra(spark, sf_dir).withColumns({
        "endpoint": F.when(ok % 3 == 0, "toxicity").otherwise("logp"),
        "split": F.when(ok % 5 == 0, "test").otherwise("train_val"),
    })


@query("cohort_inventory", COHORTS + f"select endpoint, split, source, {COUNTS} from rs group by all")
def cohort_inventory(spark, sf_dir):
    return P.grouped_inventory(_cohort_records(spark, sf_dir), ["endpoint", "split", "source"])


@query("target_summary", DOCS + """
select endpoint, case when endpoint = 'en' then 'classification' else 'regression' end as task, split, count(*) as records,
  count(distinct key) as unique_molecules, round(avg(label::double), 6) as target_mean, round(stddev_samp(label::double), 6) as target_std,
  min(label::double) as target_min, max(label::double) as target_max,
  case when endpoint = 'en' then round(avg(label::double), 6) end as positive_fraction
from labs group by endpoint, split""")
def target_summary(spark, sf_dir):
    labels = prop_labels(spark, sf_dir).withColumn("y", F.col("label").cast("double"))
    return rounded(P.target_summary(labels, ("en",)))


PROFILE_SQL = PER_RECORD + """,
prof as (select
  (select count(*) from rs) as rows, 0::bigint as h_null_records, (select count(*) from rs where n_h = 0) as h_empty_records,
  count(*) filter (where nucleus = 'h') as h_total_peaks, (select max(n_h) from rs) as h_max_peaks,
  min(shift) filter (where nucleus = 'h') as h_shift_min, max(shift) filter (where nucleus = 'h') as h_shift_max,
  0::bigint as c_null_records, (select count(*) from rs where n_c = 0) as c_empty_records,
  count(*) filter (where nucleus = 'c') as c_total_peaks, (select max(n_c) from rs) as c_max_peaks,
  min(shift) filter (where nucleus = 'c') as c_shift_min, max(shift) filter (where nucleus = 'c') as c_shift_max,
  (select count(*) from rs where n_h > 0 and n_c > 0) as both_usable,
  count(*) filter (where nucleus = 'h' and integration is null) as integration_null,
  count(*) filter (where nucleus = 'h' and integration = 0) as integration_zero,
  count(*) filter (where nucleus = 'h' and n_j is null) as j_null, count(*) filter (where nucleus = 'h' and n_j = 0) as j_empty,
  count(*) filter (where nucleus = 'h' and n_j > 0) as j_nonempty
from pk)
"""


@query("table_profile", PROFILE_SQL + "select * from prof")
def table_profile(spark, sf_dir):
    return P.table_profile(spectra(spark, sf_dir))


@query("table_value_counts", RECORDS + """
select 'source' as field, source as value, count(*) as n from recs group by source
union all select 'multiplicity', mult, count(*) from pk where nucleus = 'h' group by mult""")
def table_value_counts(spark, sf_dir):
    return P.value_counts(spectra(spark, sf_dir))


@query("duplicate_ids", """with ids as (select concat_ws(':', l_orderkey, l_linenumber) as id from lineitem)
select count(*) - count(distinct id) as duplicate_record_ids from ids""")
def duplicate_ids(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"))
    return P.duplicate_id_count(ids, "id")


def raw_landing(spark, sf_dir):
    """Raw peak lists per order, before any canonical rule."""
    flat = line_peaks(spark, sf_dir)
    raw = F.struct("shift", "integration", "n_j", "line_no", "w")
    peaks = flat.repartition("ok").groupBy("ok").agg(
        F.collect_list(F.when(F.col("nucleus") == "h", raw)).alias("h_peaks"),
        F.collect_list(F.when(F.col("nucleus") == "c", raw)).alias("c_peaks"))
    orders = order_copies(spark, sf_dir).filter("kind = 'rec'")
    return orders.join(peaks, "ok", "left").withColumn(
        "split", F.when(F.col("ok") % 10 == 0, "test").when(F.col("ok") % 10 == 1, "val").otherwise("train"))


def _raw_totals(spark, sf_dir):
    return P.raw_totals(
        raw_landing(spark, sf_dir), ["split"], integration="integration",
        j_is_missing=lambda p: p["n_j"].isNull(), j_is_empty=lambda p: F.coalesce(p["n_j"], F.lit(0)) == 0,
        h_shift=lambda p: p["shift"], c_shift=lambda p: p["shift"])


RAW_SQL = RECORDS + """,
per as (
  select case when o_orderkey % 10 = 0 then 'test' when o_orderkey % 10 = 1 then 'val' else 'train' end as split,
    count(nucleus) filter (where nucleus = 'h') as nh, count(nucleus) filter (where nucleus = 'c') as nc,
    count(*) filter (where nucleus = 'h' and integration = 0) as zero, count(*) filter (where nucleus = 'h' and n_j is null) as mj,
    count(*) filter (where nucleus = 'h' and coalesce(n_j, 0) = 0) as ej,
    count(*) filter (where nucleus = 'h' and not shift between -5 and 20) as ho,
    count(*) filter (where nucleus = 'c' and not shift between -20 and 300) as co
  from orders left join lp on o_orderkey = ok group by o_orderkey, split),
tot as (
  select split, count(*) as rows, count(*) filter (where nh = 0) as h_no_peak_records, count(*) filter (where nc = 0) as c_no_peak_records,
    count(*) filter (where nh > 0 and nc > 0) as both_modality_usable_records, sum(nh)::bigint as h_total_peaks, sum(nc)::bigint as c_total_peaks,
    max(nh) as h_max_peaks, max(nc) as c_max_peaks, sum(zero)::bigint as zero_integration_peaks, 0::bigint as j_null_peaks,
    sum(ej)::bigint as j_empty_peaks, sum(nh - ej)::bigint as j_nonempty_peaks, sum(mj)::bigint as raw_missing_j_peaks,
    count(*) filter (where zero > 0) as zero_integration_records, count(*) filter (where ho > 0) as h_shift_outlier_records,
    sum(ho)::bigint as h_shift_outlier_peaks, count(*) filter (where co > 0) as c_shift_outlier_records,
    sum(co)::bigint as c_shift_outlier_peaks, count(*) filter (where nh > 60) as records_over_60_h_peaks,
    count(*) filter (where nc > 60) as records_over_60_c_peaks
  from per group by split)
"""


@query("raw_split_totals", RAW_SQL + "select * from tot")
def raw_split_totals(spark, sf_dir):
    return _raw_totals(spark, sf_dir)


@query("source_reconciliation", RAW_SQL + f""",
src as (select {', '.join(('max' if t in P.MAXIMA else 'sum') + f'({t})::bigint as {t}' for t in P.TOTALS)} from tot),
pc as (select record_id, count(*) filter (where nucleus = 'h') as n_h, count(*) filter (where nucleus = 'c') as n_c,
    count(*) filter (where nucleus = 'h' and integration = 0) as zero, count(*) filter (where nucleus = 'h' and n_j is null) as jn,
    count(*) filter (where nucleus = 'h' and n_j = 0) as je, count(*) filter (where nucleus = 'h' and n_j > 0) as jx from pk group by 1),
rs as (select coalesce(n_h, 0) as n_h, coalesce(n_c, 0) as n_c, zero, jn, je, jx from recs r left join pc on r.record_id = pc.record_id where not is_dup),
can as (select count(*) as rows, count(*) filter (where n_h = 0) as h_no_peak_records, count(*) filter (where n_c = 0) as c_no_peak_records,
  count(*) filter (where n_h > 0 and n_c > 0) as both_modality_usable_records, sum(n_h)::bigint as h_total_peaks, sum(n_c)::bigint as c_total_peaks,
  max(n_h) as h_max_peaks, max(n_c) as c_max_peaks, sum(zero)::bigint as zero_integration_peaks, sum(jn)::bigint as j_null_peaks,
  sum(je)::bigint as j_empty_peaks, sum(jx)::bigint as j_nonempty_peaks from rs)
select metric, source_value, canonical_value, source_value = canonical_value as matches
from (unpivot src on columns(*) into name metric value source_value) a
join (unpivot can on columns(*) into name metric value canonical_value) b using (metric)""")
def source_reconciliation(spark, sf_dir):
    per_split = _raw_totals(spark, sf_dir)
    records = spectra(spark, sf_dir).filter(F.startswith(F.col("record_id"), F.lit("rec-")))
    return P.reconcile(P.combine_splits(per_split, ["split"]), P.canonical_totals(records))


@query("split_consistency", """
with t as (select o_orderkey as id, o_custkey % 10 as k, o_custkey as c from orders),
train as (select id from t where k < 8), val as (select id from t where k in (7, 8)), test as (select id from t where k = 9),
whole as (select id from t where c % 97 <> 0 union all select -1),
u as (select id, 'train' as p from train union all select id, 'val' from val union all select id, 'test' from test),
g as (select id, count(distinct p) as k from u group by id)
select (select count(*) from train) as train_count, (select count(*) from val) as val_count, (select count(*) from test) as test_count,
  (select count(*) from whole) as all_count, (select sum(k - 1)::bigint from g) as split_overlap_count,
  (select count(*) from g where id not in (select id from whole)) as missing_from_all_count,
  (select count(*) from whole where id not in (select id from g)) as extra_in_all_count, 0::bigint as duplicate_count,
  false as all_equals_split_union""")
def split_consistency(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("k"), F.col("o_custkey").alias("c"))
    parts = {"train": t.filter("k < 8"), "val": t.filter("k in (7, 8)"), "test": t.filter("k = 9")}
    stranger = spark.range(1).select(F.lit(-1).cast("bigint").alias("id"))
    return P.split_consistency(parts, t.filter("c % 97 <> 0").select("id").union(stranger), "id")


@query("sample_per_group", "with r as (select o_orderkey, o_orderpriority as source, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as k from orders) select o_orderkey, source from r where k <= 200")
def sample_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source"), "o_orderdate")
    return P.sample_per_group(rows, "source", 200, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("first_rows", "select o_orderkey, o_orderpriority from orders order by o_orderdate, o_orderkey limit 500")
def first_rows(spark, sf_dir):
    return P.first_rows(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderpriority"], 500, ["o_orderdate", "o_orderkey"])


@query("plot_ranges", """
with r as (select o_orderpriority as source, o_totalprice as v, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as k from orders),
s as (select source, v from r where k <= 300),
q as (select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from s),
b as (select q1 - 0.25e0 * (q3 - q1) as lower, q3 + 0.25e0 * (q3 - q1) as upper from q)
select source, count(*) as values, count(*) filter (where v between lower and upper) as values_in_range,
  round(min(v) filter (where v between lower and upper), 4) as shown_min, round(max(v) filter (where v between lower and upper), 4) as shown_max,
  round(max(lower), 4) as lower, round(max(upper), 4) as upper from s, b group by source""")
def plot_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("v"), "o_orderdate", "o_orderkey")
    sample = P.sample_per_group(rows, "source", 300, ["o_orderdate", "o_orderkey"])
    return rounded(P.plot_ranges(sample, "source", "v", whiskers=0.25), 4)


@query("status_counts", """with s as (select case when trim(text, ' ' || chr(10)) = '' then 'missing' when n_chars > 5000 then 'invalid' else 'ok' end as status from documents)
select status, count(*) as records from s group by status""")
def status_counts(spark, sf_dir):
    text = F.btrim("text", F.lit(" \n"))
    rows = table(spark, sf_dir, "documents").select(
        F.when(text == "", "missing").when(F.col("n_chars") > 5000, "invalid").otherwise("ok").alias("status"))
    return P.status_counts(rows, "status")


@query("display_names", """select case o_orderpriority when '1-URGENT' then 'Urgent' when '5-LOW' then 'Low priority' else o_orderpriority end as name,
count(*) as records from orders group by 1""")
def display_names(spark, sf_dir):
    named = display_name(F.col("o_orderpriority"), {"1-URGENT": "Urgent", "5-LOW": "Low priority"})
    return table(spark, sf_dir, "orders").groupBy(named.alias("name")).agg(F.count("*").alias("records"))
