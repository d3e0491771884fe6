"""Located validation issues, dialect compatibility and table guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.functions.binding import exploded
from peakloom.functions.vectors import is_valid_vector
from peakloom.operators import dialects as D
from peakloom.operators import metrics as M
from peakloom.operators import validate as V
from peakloom.plans.registry import query
from peakloom.plans.sql import DOCS, LONG_METRICS, RECORDS
from peakloom.plans.views import doc_records, long_metrics, spectra, table

# Every rule that the derived records can break, one row per issue.
ISSUES_SQL = RECORDS + """,
h as (select *, 'h_nmr_peaks[' || i || ']' as loc, range_min is not null and range_max is not null as ends,
    (range_max - range_min) / 2e0 as expected from pk where nucleus = 'h'),
found as (
  select record_id, 'incomplete_range' as code, loc as path from h where (range_min is null) <> (range_max is null)
  union all select record_id, 'invalid_range', loc from h where ends and range_min > range_max
  union all select record_id, 'shift_outside_range', loc || '.shift' from h where ends and range_min <= range_max and not shift between range_min and range_max
  union all select record_id, 'invalid_range', loc || '.range_half_span' from h where half < 0
  union all select record_id, 'inconsistent_range', loc || '.range_half_span' from h where ends and half is not null
    and abs(half - expected) > greatest(1e-6 * greatest(abs(half), abs(expected)), 1e-8))
"""


@query("validation_issues", ISSUES_SQL + "select * from found")
def validation_issues(spark, sf_dir):
    return V.issue_rows(spectra(spark, sf_dir)).select("record_id", "code", "path")


@query("validation_issue_counts", ISSUES_SQL + "select code, count(*) as occurrences, count(distinct record_id) as records from found group by code")
def validation_issue_counts(spark, sf_dir):
    codes = F.transform(V.record_issues(), lambda x: x["code"])
    checked = spectra(spark, sf_dir).select(codes.alias("codes"))
    counted = F.transform(F.array_distinct("codes"), lambda c: F.struct(
        c.alias("code"), F.size(F.filter("codes", lambda x: x == c)).alias("n")))
    return exploded(checked, items=counted).groupBy(F.col("item.code").alias("code")).agg(
        F.sum("item.n").alias("occurrences"), F.count("*").alias("records"))


DIALECT_SQL = ISSUES_SQL + """,
n as (select r.record_id, count(p.i) filter (where nucleus = 'h') as n_h, count(p.i) filter (where nucleus = 'c') as n_c
  from recs r left join pk p on r.record_id = p.record_id group by 1),
both_missing as (
  select record_id, 'missing_h_nmr' as code from n where n_h = 0 union all select record_id, 'missing_c_nmr' from n where n_c = 0),
ranged as (
  select * from both_missing
  union all select record_id, 'invalid_integration' from h where not coalesce(integration between 1 and 50, false)
  union all select record_id, 'missing_multiplicity' from h where mult is null
  union all select record_id, 'missing_j_values' from h where n_j is null
  union all select record_id, 'missing_shift_range' from h where range_min is null or range_max is null),
tokenised as (
  select * from both_missing
  union all select record_id, 'missing_integration' from h where not coalesce(integration > 0, false)
  union all select record_id, 'missing_multiplicity' from h where mult is null
  union all select record_id, 'missing_j_values' from h where n_j is null
  union all select record_id, 'too_many_j_values' from h where n_j > 6
  union all select record_id, 'missing_peak_width' from h where half is null and (range_min is null or range_max is null)),
expanded as (
  select * from both_missing
  union all select record_id, 'empty_member_shifts' from h where n_members = 0
  union all select record_id, 'missing_proton_expansion' from h where n_members is null and not coalesce(integration > 0, false)),
all_issues as (
  select 'ranged' as dialect, record_id, code from ranged union all select 'tokenised', record_id, code from tokenised
  union all select 'expanded', record_id, code from expanded union all select 'shift_set', record_id, code from expanded
  union all select d, record_id, code from found, (values ('ranged'), ('tokenised'), ('expanded'), ('shift_set')) t(d))
"""


@query("dialect_compatibility", DIALECT_SQL + """
select dialect, (select count(*) from recs) - count(distinct record_id) as accepted_records, count(distinct record_id) as rejected_records
from all_issues group by dialect""")
def dialect_compatibility(spark, sf_dir):
    return D.compatibility_summary(spectra(spark, sf_dir))


@query("dialect_issue_counts", DIALECT_SQL + """
select dialect, code, count(*) as occurrences, count(distinct record_id) as records from all_issues group by all""")
def dialect_issue_counts(spark, sf_dir):
    return D.compatibility_issue_counts(spectra(spark, sf_dir))


@query("encoder_rejections", ISSUES_SQL + """
select record_id, count(*) as issues from (
  select record_id from found union all select record_id from h where n_j > 6) group by record_id""")
def encoder_rejections(spark, sf_dir):
    found = spectra(spark, sf_dir).select("record_id", F.size(D.encoder_issues()).cast("bigint").alias("issues"))
    return found.filter("issues > 0")


PROPERTY_SQL = """
with p as (
  select doc_id, case when doc_id % 13 = 0 then 'failed' else 'ok' end as status, quality, toxic,
    case when doc_id % 17 = 0 then null when doc_id % 19 = 0 then 'NaN'::double else doc_id * 0.5e0 end as weight
  from labels),
r as (select doc_id, case when status <> 'ok' then 'status' when quality not in (0, 1) then 'quality' when toxic not in (0, 1) then 'toxic'
  when weight is null or isnan(weight) then 'weight' end as reason from p)
"""


def _properties(spark, sf_dir):
    doc = F.col("doc_id")
    return table(spark, sf_dir, "labels").withColumns({
        "status": F.when(doc % 13 == 0, "failed").otherwise("ok"),
        "weight": F.when(doc % 17 == 0, None).when(doc % 19 == 0, F.lit(float("nan"))).otherwise(doc * 0.5),
    })


@query("property_row_check", PROPERTY_SQL + "select * from r")
def property_row_check(spark, sf_dir):
    reason = V.first_invalid_property(F.col("status"), ("quality", "toxic"), ("weight",), "status")
    return _properties(spark, sf_dir).select("doc_id", reason.alias("reason"))


@query("ineligible_counts", PROPERTY_SQL + """select case when doc_id % 5 = 0 then 'missing_modality' else 'invalid_' || reason end as reason,
count(*) as records from r where reason is not null or doc_id % 5 = 0 group by 1""")
def ineligible_counts(spark, sf_dir):
    reason = V.first_invalid_property(F.col("status"), ("quality", "toxic"), ("weight",), "status")
    first = F.when(F.col("doc_id") % 5 == 0, "missing_modality").otherwise(F.concat(F.lit("invalid_"), reason))
    return _properties(spark, sf_dir).select(first.alias("reason")).filter("reason is not null").groupBy("reason").agg(
        F.count("*").alias("records"))


@query("empty_key_audit", DOCS + """, k as (select doc_id, case when n_chars % 40 = 0 then '' else key end as key, case when n_chars % 70 = 1 then null else lang end as lang from docs)
select 'key' as column_name, count(*) filter (where coalesce(key = '', true)) as empty_rows, min(doc_id) filter (where coalesce(key = '', true)) as first_row from k
union all select 'lang', count(*) filter (where coalesce(lang = '', true)), min(doc_id) filter (where coalesce(lang = '', true)) from k""")
def empty_key_audit(spark, sf_dir):
    docs = doc_records(spark, sf_dir).select(
        "doc_id", F.when(F.col("n_chars") % 40 == 0, "").otherwise(F.col("key")).alias("key"),
        F.when(F.col("n_chars") % 70 != 1, F.col("lang")).alias("lang"))
    return V.empty_key_audit(docs, ["key", "lang"], "doc_id")


@query("vector_validity", """
with c as (select vec_id, case when vec_id % 50 = 0 then embedding[1:63] when vec_id % 50 = 1 then list_transform(embedding, lambda x: 0::float)
  when vec_id % 50 = 2 then list_concat(embedding[1:63], [null]) else embedding end as v from embeddings)
select vec_id, len(v) = 64 and len(list_filter(v, lambda x: x is null)) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0 as valid from c""")
def vector_validity(spark, sf_dir):
    e, k = F.col("embedding"), F.col("vec_id") % 50
    short = F.slice(e, 1, 63)
    v = F.when(k == 0, short).when(k == 1, F.transform(e, lambda x: x * 0)).when(
        k == 2, F.concat(short, F.array(F.lit(None).cast("float")))).otherwise(e)
    return table(spark, sf_dir, "embeddings").select("vec_id", is_valid_vector(v, 64).alias("valid"))


@query("result_grid_audit", LONG_METRICS + """,
res as (select representation, probe, 'e' || target as dataset, avg(roc_auc) as score, case when target = '3' then 2 else 1 end as n
  from lm where not (representation = 'A' and target = '1') group by all),
want as (select r.representation, p.probe, 'e' || t.t as dataset from (values ('A'), ('N'), ('R')) r(representation),
  (values ('F'), ('O')) p(probe), (select unnest(range(8)) as t) t)
select coalesce(w.representation, r.representation) as representation, coalesce(w.probe, r.probe) as probe, coalesce(w.dataset, r.dataset) as dataset,
  case when r.score is null then 'missing' when w.dataset is null then 'unexpected' when n > 1 then 'repeated' else 'ok' end as status
from want w full join res r on w.representation = r.representation and w.probe = r.probe and w.dataset = r.dataset""")
def result_grid_audit(spark, sf_dir):
    rows = long_metrics(spark, sf_dir).filter("not (representation = 'A' and target = '1')").groupBy(
        "representation", "probe", F.concat(F.lit("e"), "target").alias("dataset")).agg(F.avg("roc_auc").alias("score"))
    twice = rows.filter("dataset = 'e3'")
    return M.grid_audit(rows.unionByName(twice), {
        "representation": ["A", "N", "R"], "probe": ["F", "O"], "dataset": [f"e{i}" for i in range(8)]}, "score")
