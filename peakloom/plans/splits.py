"""Hold-outs, strata, folds, shards, mixtures and shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.functions import keyed_random as R
from peakloom.operators import split as S
from peakloom.plans.registry import query
from peakloom.plans.sql import DOCS, POOLS
from peakloom.plans.views import cache, doc_records, pools, table

SCORE = "substr(sha256('{seed}' || chr(0) || {key}), 1, 16)"


def score_sql(seed, key="key"):
    return SCORE.format(seed=seed, key=key)


def lowest_sql(pool, n, seed):
    return f"""select distinct key from (select key, row_number() over (order by {score_sql(seed)}, key desc) as p from {pool}) where p <= {n}"""


HELD = POOLS + f""", held as ({lowest_sql('bench', 300, 42)} union {lowest_sql('pool_t', 200, 42)} union {lowest_sql('pool_a', 50, 42)})
"""


def _held(spark, sf_dir):
    p = pools(spark, sf_dir)
    return S.shared_holdout({k: p[k] for k in ("bench", "t", "a")}, {"bench": 300, "t": 200, "a": 50}, "key", 42)


@query("lowest_score_keys", POOLS + lowest_sql("bench", 300, 42))
def lowest_score_keys(spark, sf_dir):
    return S.lowest_records(pools(spark, sf_dir)["bench"], "key", 300, 42)


@query("shared_holdout", HELD + """select *, case when key in (select key from held) then 'validation' else 'train' end as split
from (select * from bench union all select * from pool_t union all select * from pool_a)""")
def shared_holdout(spark, sf_dir):
    p = pools(spark, sf_dir)
    held = _held(spark, sf_dir)
    rows = p["bench"].unionByName(p["t"]).unionByName(p["a"])
    return S.apply_holdout(rows, held, "key").select("record_id", "key", "source", "split")


@query("split_counts", HELD + """select source, case when key in (select key from held) then 'validation' else 'train' end as split,
count(*) as records, count(distinct key) as molecules from (select * from bench union all select * from pool_t) group by all""")
def split_counts(spark, sf_dir):
    p = pools(spark, sf_dir)
    rows = S.apply_holdout(p["bench"].unionByName(p["t"]), _held(spark, sf_dir), "key")
    return rows.groupBy("source", "split").agg(
        F.count("*").alias("records"), F.count_distinct("key").alias("molecules"))


@query("representatives", POOLS + "select key, min(record_id) as record_id, arg_min(source, record_id) as source from pools group by key")
def representatives(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("record_id"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("key"),
        F.col("o_orderpriority").alias("source"))
    return S.representatives(orders, "key", "source")


@query("first_keys", POOLS + f""", r as (select key, row_number() over (order by {score_sql(42)}, key) as p from (select distinct key from pools))
select key, p as position, case when p <= 200 then 'train' else 'validation' end as split from r where p <= 260""")
def first_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("key")).distinct()
    return S.first_keys(keys, "key", {"train": 200, "validation": 60}, 42)


STRATA = POOLS + """,
ps as (select key, source, count(*) as n from pools group by 1, 2),
mol as (select key, sum(n)::bigint as records, string_agg(source || '=' || n, ';' order by source) as stratum from ps group by key)
"""


def _strata(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("source"))
    return S.source_strata(orders, "key")


@query("source_strata", STRATA + "select * from mol")
def source_strata(spark, sf_dir):
    return _strata(spark, sf_dir)


@query("stratified_quota", POOLS + f""",
ps as (select key, source as src, count(*) as n from pools group by 1, 2),
mol as (select key, sum(n)::bigint as records, string_agg(case when n > 1 then 'many' else src end, ';' order by src) as stratum from ps group by key),
tot as (select sum(records) as t from mol),
r as (select mol.*, row_number() over (partition by stratum order by {score_sql(7)}, key) as p, count(*) over (partition by stratum) as n from mol),
q as (select *, round_even(n * 2000e0 / t, 0) as a, round_even(n * 1000e0 / t, 0) as b from r, tot)
select key, records, stratum, case when p <= a then 'train' else 'eval' end as split from q where p <= a + b""")
def stratified_quota(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("source"))
    per_source = orders.groupBy("key", "source").agg(F.count("*").alias("n"))
    mix = F.sort_array(F.collect_list(F.struct("source", "n")))
    molecules = per_source.groupBy("key").agg(
        F.sum("n").alias("records"),
        F.array_join(F.transform(mix, lambda x: F.when(x["n"] > 1, "many").otherwise(x["source"])), ";").alias("stratum"))
    return S.stratified_quota(molecules, "key", {"train": 2000, "eval": 1000}, 7, orders.count())


@query("grouped_holdout", DOCS + f""",
r as (select key, row_number() over (order by {score_sql(42)}, key) as p, count(*) over () as n from (select distinct key from docs))
select key, case when p <= greatest(round_even(n * 0.1e0, 0), 1) then 'validation' else 'train' end as split from r""")
def grouped_holdout(spark, sf_dir):
    return S.grouped_holdout(doc_records(spark, sf_dir), "key", 0.1, 42)


@query("grouped_holdout_by_class", DOCS + f""",
g as (select key, min(n_chars % 2) || '-' || max(n_chars % 2) as c from docs group by key),
r as (select key, row_number() over (partition by c order by {score_sql(42)}, key) as p, count(*) over (partition by c) as n from g)
select key, case when p <= greatest(round_even(n * 0.2e0, 0), 1) then 'validation' else 'train' end as split from r""")
def grouped_holdout_by_class(spark, sf_dir):
    docs = doc_records(spark, sf_dir).withColumn("y", F.col("n_chars") % 2)
    return S.grouped_holdout(docs, "key", 0.2, 42, label="y")


@query("grouped_folds", DOCS + f"""
select record_id, key, cast(('0x' || substr({score_sql(42)}, 1, 8))::bigint % 5 as integer) as fold from docs""")
def grouped_folds(spark, sf_dir):
    return doc_records(spark, sf_dir).select("record_id", "key", S.fold_number(F.col("key"), 5, 42).alias("fold"))


@query("shards", """select vec_id, cast((vec_id // 32) % 6 % 2 as integer) as rank, cast(((vec_id // 32) % 6) // 2 as integer) as worker from embeddings""")
def shards(spark, sf_dir):
    block = F.floor(F.col("vec_id") / 32)
    return table(spark, sf_dir, "embeddings").select("vec_id").withColumns(S.shard_number(block, 2, 3))


@query("starved_shards", """with b as (select distinct (vec_id // 32) % 40 as shard from embeddings)
select cast(r.range as integer) as shard from range(40) r where r.range not in (select shard from b)""")
def starved_shards(spark, sf_dir):
    blocks = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 32).alias("block"))
    return S.starved_shards(blocks, "block", 8, 5)


WEIGHTS = {"1-URGENT": 0.5, "2-HIGH": 0.3, "5-LOW": 0.2}


@query("source_mixture", """
with p as (select 'o-' || o_orderkey as record_id, o_orderpriority as source from orders),
w(source, weight) as (values ('1-URGENT', 0.5e0), ('2-HIGH', 0.3e0), ('5-LOW', 0.2e0)),
q as (select source, cast(round_even(weight * (select count(*) from p), 0) as bigint) as quota from w),
n as (select source, count(*) as n, quota from p join q using (source) group by all),
c as (select p.*, n.n, n.quota, unnest(range(1, cast(ceil(quota / n.n) as bigint) + 1)) as copy_no from p join n using (source)),
r as (select *, row_number() over (partition by source, copy_no order by sha256('42:mix:' || source || ':' || record_id), record_id) as k from c)
select record_id, source, copy_no from r where copy_no <= quota // n or k <= quota - (quota // n) * n""")
def source_mixture(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("record_id"), F.col("o_orderpriority").alias("source"))
    return S.mix_sources(records, WEIGHTS, records.count(), 42)


@query("shuffled_order", """select record_id, row_number() over (order by sha256('42:shuffle:' || record_id), record_id) as position
from (select 'v-' || vec_id as record_id from embeddings)""")
def shuffled_order(spark, sf_dir):
    from peakloom.operators.ranking import position_by_score

    ids = cache(spark, sf_dir).select("record_id")
    order = R.digest(42, "shuffle", F.col("record_id"))
    return S.shuffled(position_by_score(ids, order, [F.col("record_id")]).drop("group_size"), 42)
