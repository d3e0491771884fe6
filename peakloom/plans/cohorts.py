"""Label cohorts and fraction splits on document identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.operators import cohort as C
from peakloom.plans.registry import query
from peakloom.plans.sql import DOCS
from peakloom.plans.views import doc_records, pool_records, prop_labels
from peakloom.sources.readers import WORKBOOK_COLUMNS, select_workbook_rows, workbook_counts

CLEANED = DOCS + """,
cross_keys as (select endpoint, key from labs group by 1, 2 having count(distinct split) > 1),
own as (select * from labs where (endpoint, key) not in (select (endpoint, key) from cross_keys)),
con as (select endpoint, split, key, count(*) as label_rows, count(distinct label::double) > 1 as discordant,
    min(row_no) as row_no, arg_min(label, row_no) as label from own group by 1, 2, 3)
"""


@query("cross_split_keys", CLEANED + "select * from cross_keys")
def cross_split_keys(spark, sf_dir):
    return C.cross_split_keys(prop_labels(spark, sf_dir))


def _consolidated(spark, sf_dir):
    return C.consolidate(C.drop_cross_split(prop_labels(spark, sf_dir)))


@query("label_consolidation", CLEANED + "select * from con")
def label_consolidation(spark, sf_dir):
    return _consolidated(spark, sf_dir)


@query("label_expansion", CLEANED + """
select d.record_id, c.key, c.endpoint, c.split, c.row_no, c.label from con c join docs d on c.key = d.key where not discordant""")
def label_expansion(spark, sf_dir):
    return C.expand(_consolidated(spark, sf_dir), doc_records(spark, sf_dir))


@query("label_statistics", CLEANED + """, n as (select key, count(*) as n from docs group by key)
select endpoint, split, sum(label_rows)::bigint as matched_property_rows, sum(n)::bigint as matched_records,
  coalesce(sum(n) filter (where not discordant), 0)::bigint as output_records,
  count(*) filter (where not discordant and label_rows > 1) as agreeing_duplicates,
  count(*) filter (where discordant) as discordant_molecules
from con join n using (key) group by 1, 2""")
def label_statistics(spark, sf_dir):
    return C.release_statistics(_consolidated(spark, sf_dir), doc_records(spark, sf_dir))


@query("training_pool", DOCS + "select record_id, key, source from docs where key not in (select key from labs)")
def training_pool(spark, sf_dir):
    return C.training_pool(doc_records(spark, sf_dir), prop_labels(spark, sf_dir)).select("record_id", "key", "source")


@query("fraction_split", DOCS + """,
r as (select key, row_number() over (order by sha256('42:' || key), key) as p, count(*) over () as n from (select distinct key from docs))
select key, case when p <= least(greatest(round_even(n * 0.8e0, 0), 1), n - 1) then 'train_val' else 'test' end as split from r""")
def fraction_split(spark, sf_dir):
    return C.fraction_split(doc_records(spark, sf_dir), "key", 0.8, 42)


@query("split_unsplit_release", DOCS + """,
m as (select distinct key from labs where endpoint = 'en' and key in (select key from pool)),
r as (select key, row_number() over (order by sha256('7:' || key), key) as p, count(*) over () as n from m)
select l.key, l.label, l.row_no, case when p <= least(greatest(round_even(n * 0.8e0, 0), 1), n - 1) then 'train_val' else 'test' end as split
from labs l join r on l.key = r.key where endpoint = 'en'""")
def split_unsplit_release(spark, sf_dir):
    unsplit = prop_labels(spark, sf_dir).filter("endpoint = 'en'").select("key", "label", "row_no")
    records = pool_records(spark, sf_dir)
    return C.split_labels(unsplit, records, "key", 0.8, 7)


def _workbook(spark, sf_dir):
    """An export with blank rows, two classes and unreadable structures."""
    docs = doc_records(spark, sf_dir)
    blank = F.col("doc_id") % 11 == 0
    names = dict(zip(("s", "v", "k"), WORKBOOK_COLUMNS))
    return docs.select(
        F.when(~blank, F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("key"))).alias("s"),
        F.when(~blank, (F.col("n_chars") % 10).cast("string")).alias("v"),
        F.when(~blank, F.when(F.col("doc_id") % 3 == 0, "P").otherwise("N")).alias("k"),
    ).withColumnsRenamed(names)


@query("workbook_rows", DOCS + """select key as "Drug_ID", key as "Drug", (n_chars % 10)::varchar as "Y" from docs
where doc_id % 11 <> 0 and doc_id % 7 <> 0 and doc_id % 3 = 0""")
def workbook_rows(spark, sf_dir):
    return select_workbook_rows(_workbook(spark, sf_dir))


@query("workbook_counts", DOCS + """select count(*) filter (where doc_id % 11 <> 0) as source_rows,
count(*) filter (where doc_id % 11 <> 0 and doc_id % 3 = 0 and doc_id % 7 <> 0) as kept_rows,
count(*) filter (where doc_id % 11 <> 0 and doc_id % 3 = 0 and doc_id % 7 = 0) as invalid_rows from docs""")
def workbook_row_counts(spark, sf_dir):
    return workbook_counts(_workbook(spark, sf_dir))
