"""Leakage between pools, merging and identity audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.operators import overlap as O
from peakloom.plans.registry import query
from peakloom.plans.sql import DOCS, POOLS
from peakloom.plans.views import doc_records, pool_records, pools, prop_labels

HITS = POOLS + """,
hits as (select key, min(o) as o from (select key, 0 as o from pool_a union all select key, 1 from pool_b) group by key)
"""


@query("decontaminate", HITS + "select * from bench where key not in (select key from hits)")
def decontaminate(spark, sf_dir):
    p = pools(spark, sf_dir)
    return O.decontaminate(p["bench"], [p["a"], p["b"]], "key").select("record_id", "key", "source")


@query("decontaminate_counts", HITS + """select (select count(*) from bench) as input_records,
(select count(*) from bench where key not in (select key from hits)) as output_records,
(select count(*) from bench where key in (select key from hits)) as removed_records,
(select count(distinct key) from bench where key in (select key from hits)) as removed_molecules""")
def decontaminate_counts(spark, sf_dir):
    p = pools(spark, sf_dir)
    return O.decontamination_counts(p["bench"], [p["a"], p["b"]], "key")


@query("first_match_attribution", HITS + """, n as (select o, count(*) as c from hits where key in (select key from bench) group by o)
select 'a' as comparison, coalesce((select c from n where o = 0), 0) as new_molecules
union all select 'b', coalesce((select c from n where o = 1), 0) union all select 'a again', 0::bigint""")
def first_match_attribution(spark, sf_dir):
    p = pools(spark, sf_dir)
    return O.attribution(p["bench"], {"a": p["a"], "b": p["b"], "a again": p["a"]}, "key")


@query("matched_keys", POOLS + "select distinct key from pool_a where key in (select key from bench)")
def matched_keys(spark, sf_dir):
    p = pools(spark, sf_dir)
    return O.matched_keys(p["bench"], p["a"], "key")


MOVED = POOLS + """, moved as (select * from bench where key in (select key from pool_d))"""


@query("transfer_train", MOVED + "select * from pool_t union all select * from moved")
def transfer_train(spark, sf_dir):
    p = pools(spark, sf_dir)
    return O.transfer(p["bench"], p["d"], p["t"], "key")[1]


@query("transfer_remaining", MOVED + "select * from bench where key not in (select key from pool_d)")
def transfer_remaining(spark, sf_dir):
    p = pools(spark, sf_dir)
    return O.transfer(p["bench"], p["d"], p["t"], "key")[0].select("record_id", "key", "source")


@query("transfer_conflicts", MOVED + """, twice as (select record_id from pool_t union all select record_id from moved where substr(record_id, -1) = '7')
select record_id from moved where record_id in (select record_id from twice)""")
def transfer_conflicts(spark, sf_dir):
    p = pools(spark, sf_dir)
    moved = O.transfer(p["bench"], p["d"], p["t"], "key")[2]
    already = moved.filter(F.endswith(F.col("record_id"), F.lit("7")))
    return O.transfer_conflicts(moved, p["t"].select("record_id").unionByName(already.select("record_id")))


@query("merge_ordered", POOLS + """select *, 0 as input_order from bench union all select *, 1 from pool_t union all select *, 2 from pool_a""")
def merge_ordered(spark, sf_dir):
    p = pools(spark, sf_dir)
    return O.merge_tables([p["bench"], p["t"], p["a"]])


@query("key_set_operations", POOLS + """
select 'both' as side, count(*) as n from (select key from bench intersect select key from pool_t)
union all select 'only_bench', count(*) from (select key from bench except select key from pool_t)
union all select 'either', count(*) from (select key from bench union select key from pool_t)""")
def key_set_operations(spark, sf_dir):
    p = pools(spark, sf_dir)
    sides = O.union_all([
        p["bench"].select("key", F.lit(1).alias("bit")), p["t"].select("key", F.lit(2).alias("bit"))])
    seen = sides.groupBy("key").agg(F.bit_or("bit").alias("seen"))
    counts = seen.agg(
        F.count_if(F.col("seen") == 3).alias("both"), F.count_if(F.col("seen") == 1).alias("only_bench"),
        F.count("*").alias("either"))
    return counts.unpivot([], ["both", "only_bench", "either"], "side", "n")


@query("held_out_overlap", POOLS + "select distinct key from bench where key in (select key from pool_t)")
def held_out_overlap(spark, sf_dir):
    p = pools(spark, sf_dir)
    return O.held_out_overlap(p["t"], p["bench"], "key")


INDEX = DOCS + """,
idx as (select key, substr(key, 1, 2) as connectivity, arg_min(lang, doc_id) as representative, count(*) as record_count
  from pool group by key)
"""


def _index(spark, sf_dir):
    return O.identity_index(pool_records(spark, sf_dir), "key", "lang", "doc_id")


@query("identity_index", INDEX + "select * from idx")
def identity_index(spark, sf_dir):
    return _index(spark, sf_dir)


@query("identity_totals", DOCS + """, k as (select case when n_chars % 50 = 0 then null else key end as key from docs)
select count(*) as records, count(*) filter (where key is null) as unkeyed_records, count(distinct key) as unique_molecules,
  count(key) - count(distinct key) as duplicates_beyond_unique from k""")
def identity_totals(spark, sf_dir):
    docs = doc_records(spark, sf_dir).select(F.when(F.col("n_chars") % 50 != 0, F.col("key")).alias("key"))
    return O.identity_totals(docs, "key")


@query("overlap_audit", INDEX + """,
pr as (select endpoint, case when row_no % 41 = 0 then null else key end as key from labs),
k as (select endpoint, p.key, substr(p.key, 1, 2) as conn, record_count from (select distinct endpoint, key from pr where key is not null) p left join idx using (key)),
g as (select endpoint, conn, bool_or(record_count is not null) as hit from k where conn in (select connectivity from idx) group by 1, 2)
select endpoint, count(*) as property_rows, count(*) filter (where key is null) as invalid_rows,
  count(distinct key) as unique_molecules, count(key) - count(distinct key) as rows_beyond_unique,
  (select count(record_count) from k where k.endpoint = pr.endpoint) as exact_overlap,
  round(100e0 * (select count(record_count) from k where k.endpoint = pr.endpoint) / count(distinct key), 2) as exact_overlap_percent,
  (select coalesce(sum(record_count), 0)::bigint from k where k.endpoint = pr.endpoint) as matched_records,
  (select count(*) from g where g.endpoint = pr.endpoint) as connectivity_overlap,
  (select count(*) from g where g.endpoint = pr.endpoint and not hit) as connectivity_only
from pr group by endpoint""")
def overlap_audit(spark, sf_dir):
    properties = prop_labels(spark, sf_dir).select(
        "endpoint", F.when(F.col("row_no") % 41 != 0, F.col("key")).alias("key"))
    return O.overlap_audit(properties, _index(spark, sf_dir), "endpoint", "key")


@query("overlap_details", INDEX + """
select l.endpoint, l.split, l.key, l.label, l.row_no, i.connectivity, i.representative, i.record_count from labs l join idx i on l.key = i.key""")
def overlap_details(spark, sf_dir):
    return O.overlap_details(prop_labels(spark, sf_dir), _index(spark, sf_dir), "key")
