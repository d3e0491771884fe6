"""Filter and deduplicate."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.operators import clean as C
from peakloom.plans.registry import query
from peakloom.plans.sql import RECORDS
from peakloom.plans.views import spectra

POLICY = C.CleaningPolicy(max_j_values=4)

AUDIT_SQL = RECORDS + """,
agg as (
  select record_id,
    count(*) filter (where nucleus = 'h') as n_h, count(*) filter (where nucleus = 'c') as n_c,
    bool_or(nucleus = 'h' and (shift < -5 or shift > 20)) as h_out,
    bool_or(nucleus = 'c' and (shift < -50 or shift > 300)) as c_out,
    bool_or(nucleus = 'h' and coalesce(n_j, 0) > 4) as many_j,
    bool_or(nucleus = 'h' and coalesce(integration <= 0, false)) as bad_int,
    sum(case when nucleus = 'h' then (integration is not null)::int + (mult is not null)::int + (n_j is not null)::int
      + (half is not null or (range_min is not null and range_max is not null))::int else 0 end) as annotations,
    sum(case when nucleus = 'h' then (integration is null)::int + coalesce(mult = '<unk>', true)::int + (n_j is null)::int
      + (not (half is not null or (range_min is not null and range_max is not null)))::int else 0 end) as missing,
    list(shift order by shift) filter (where nucleus = 'h') as h, list(shift order by shift) filter (where nucleus = 'c') as c
  from pk group by record_id),
audit as (
  select r.record_id, r.mol_key, r.source, coalesce(n_h, 0) as n_h, coalesce(n_c, 0) as n_c,
    nullif(concat_ws(';',
      case when coalesce(n_h, 0) = 0 and coalesce(n_c, 0) = 0 then 'no_nmr_peaks' end,
      case when h_out then 'h_shift_out_of_range' end, case when c_out then 'c_shift_out_of_range' end,
      case when n_h > 60 then 'too_many_h_peaks' end, case when n_c > 60 then 'too_many_c_peaks' end,
      case when many_j then 'too_many_j_values' end, case when bad_int then 'non_positive_h_integration' end), '') as reasons,
    coalesce(h, []) as h, coalesce(c, []) as c, coalesce(annotations, 0) as annotations, coalesce(missing, 0) as missing
  from recs r left join agg a on r.record_id = a.record_id),
ranked as (
  select record_id, first_value(record_id) over w as winner, row_number() over w as rn
  from audit where reasons is null
  window w as (partition by mol_key, h, c order by annotations desc, missing, record_id)),
removed as (
  select record_id, reasons as removal_reason, cast(null as varchar) as duplicate_of from audit where reasons is not null
  union all
  select record_id, 'duplicate_shift_signature', winner from ranked where rn > 1)
"""


@query("clean_removals", AUDIT_SQL + "select * from removed")
def clean_removals(spark, sf_dir):
    return C.removals(spectra(spark, sf_dir), POLICY, staged=True)


@query("clean_kept", AUDIT_SQL + """select record_id, source, n_h, n_c from audit
where record_id not in (select record_id from removed)""")
def clean_kept(spark, sf_dir):
    return C.clean(spectra(spark, sf_dir), POLICY, staged=True).select(
        "record_id", "source",
        F.size("h_nmr_peaks").cast("bigint").alias("n_h"), F.size("c_nmr_peaks").cast("bigint").alias("n_c"))


@query("clean_reason_counts", AUDIT_SQL + """select reason, count(*) as records
from (select unnest(string_split(removal_reason, ';')) as reason from removed) group by reason""")
def clean_reason_counts(spark, sf_dir):
    return C.reason_counts(C.removals(spectra(spark, sf_dir), POLICY, staged=True))


@query("clean_reconciliation", AUDIT_SQL + """select (select count(*) from recs) as input_records,
count(*) filter (where duplicate_of is null) as filtered_records,
count(*) filter (where duplicate_of is not null) as duplicate_records,
(select count(*) from recs) - count(*) as output_records from removed""")
def clean_reconciliation(spark, sf_dir):
    records = spectra(spark, sf_dir)
    return C.reconciliation(records, C.removals(records, POLICY, staged=True))
