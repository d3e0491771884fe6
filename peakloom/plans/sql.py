"""The same views as SQL text for the comparison engine."""

LINE_PEAKS = """
lp0 as (
  select l_orderkey as ok,
    case when l_linestatus = 'O' then 'h' else 'c' end as nucleus,
    case when l_linestatus = 'O' then l_quantity * 0.5625e0 - 6e0 else l_extendedprice / 256e0 - 60e0 end as shift,
    case when l_returnflag = 'N' and l_linenumber = 1 then null else cast(l_linenumber % 7 as bigint) end as integration,
    case l_linenumber when 1 then 's' when 2 then 'D' when 3 then 'p' when 4 then 'brd' when 5 then 'hept' when 6 then 'xyz' end as mtrim,
    case l_linenumber when 1 then 's' when 2 then ' D ' when 3 then 'p' when 4 then 'brd' when 5 then 'hept' when 6 then 'xyz' end as mraw,
    case l_linenumber when 1 then 's' when 2 then 'd' when 3 then 'quint' when 4 then 'bd' when 5 then 'sept' when 6 then '<unk>' end as mult,
    case when l_tax < 0.015e0 then null when l_linenumber = 6 then 0 else l_linenumber end as n_j,
    l_discount * 100 as j_value, l_linenumber * 0.015625e0 as w, l_suppkey % 50 as defect,
    l_linenumber as line_no, l_partkey % 5 as eq_class, l_quantity as integral,
    case when l_returnflag <> 'R' then l_discount end as intensity, l_tax as width
  from lineitem),
lp as (
  select *,
    case when line_no = 3 then null when defect = 1 then shift + w when defect = 2 then shift + 8e0 - w else shift - w end as range_min,
    case when line_no = 3 or defect = 0 then null when defect = 1 then shift - w when defect = 2 then shift + 8e0 + w else shift + w end as range_max,
    case when line_no = 3 then null when defect = 3 then -0.25e0 else w end as half,
    case when line_no = 2 then 2 when line_no = 5 then 0 end as n_members
  from lp0),
recs as (
  select o_orderkey as ok, false as is_dup, 'rec-' || o_orderkey as record_id, o_orderpriority as source,
    'M' || (o_custkey % 50) as mol_key, case when o_custkey % 11 <> 0 then cast(o_custkey % 40 as integer) end as n_atoms
  from orders
  union all
  select o_orderkey, true, 'dup-' || o_orderkey, o_orderpriority, 'M' || (o_custkey % 50),
    case when o_custkey % 11 <> 0 then cast(o_custkey % 40 as integer) end
  from orders where o_orderkey % 25 = 0),
pk0 as (
  select r.record_id, r.source, r.mol_key, r.n_atoms, r.is_dup, lp.* exclude (integration, mraw, mult),
    case when is_dup then null else integration end as integration,
    case when is_dup then null else mraw end as mraw, case when is_dup then null else mult end as mult
  from recs r join lp on r.ok = lp.ok),
pk as (
  select *, row_number() over (partition by record_id, nucleus order by shift,
      case when nucleus = 'h' then integration end nulls first, case when nucleus = 'h' then mraw end nulls first,
      case when nucleus = 'h' then mult end nulls first,
      case when nucleus = 'h' then (case when n_j is null then 0 when n_j = 0 then 1 else 2 end) end,
      case when nucleus = 'h' and n_j > 0 then j_value end nulls first, case when nucleus = 'h' then n_j end nulls first,
      case when nucleus = 'h' then range_min end nulls first, case when nucleus = 'h' then range_max end nulls first,
      case when nucleus = 'h' then half end nulls first, case when nucleus = 'h' then eq_class end,
      case when nucleus = 'h' then n_members end nulls first,
      case when nucleus = 'c' then integral end, case when nucleus = 'c' then intensity end nulls first,
      case when nucleus = 'c' then width end) - 1 as i
  from pk0)
"""
RECORDS = "with " + LINE_PEAKS

POOLS = """
with pools as (
  select 'o-' || o_orderkey as record_id, 'C' || o_custkey as key, o_custkey as cust, o_orderpriority as source from orders),
bench as (select record_id, key, source from pools where source = '1-URGENT'),
pool_a as (select record_id, key, source from pools where source = '2-HIGH' and cust % 7 = 0),
pool_b as (select record_id, key, source from pools where source = '3-MEDIUM' and cust % 5 = 0),
pool_t as (select record_id, key, source from pools where source = '5-LOW'),
pool_d as (select record_id, key, source from pools where source = '4-NOT SPECIFIED')
"""

DOCS = """
with dk as (select *, sha256(trim(text, ' ' || chr(10))) as hk from documents),
docs as (select 'doc-' || doc_id as record_id, substr(hk, 1, 2) || '-' || hk as key, source, lang, n_chars, doc_id from dk),
labs as (
  select lang as endpoint, case when doc_id % 5 = 0 then 'test' else 'train_val' end as split,
    substr(hk, 1, 2) || '-' || hk as key,
    case when doc_id % 4 < 2 then cast(doc_id % 2 as varchar) else (doc_id % 2) || '.00' end as label,
    doc_id as row_no
  from dk where doc_id % 3 <> 0),
pool as (select * from docs where source not in ('src1', 'src7', 'src13'))
"""

SCORES = """
with sc as (
  select l.doc_id, d.lang, l.quality, l.toxic, cast(d.n_chars % 97 as double) as score,
    cast(d.n_chars % 89 as double) as score_toxic
  from labels l join documents d on l.doc_id = d.doc_id)
"""

CACHE = """
with cache as (select 'v-' || vec_id as record_id, vec_id, embedding, label from embeddings)
"""

def group_folds(groups: str, folds: int, seed: int) -> str:
    """Views that end in `folds (key, fold)`, from `groups (key, v0, v1)`: rows of each of two classes per group.

    The text begins a recursive list of views.
    """
    each = f"range(0, {folds})"
    return f"""
with recursive groups as ({groups}),
ranked as (
  select *, row_number() over (partition by v0, v1 order by substr(sha256('{seed}' || chr(0) || key), 1, 16), key) as position,
    count(*) over (partition by v0, v1) as m
  from groups),
strata as (select v0, v1, count(*) as m from groups group by all),
totals as (
  select sum(v0 * m)::hugeint as t0, sum(v1 * m)::hugeint as t1, coalesce(sum(v0 * (m // {folds})), 0)::hugeint as d0,
    coalesce(sum(v1 * (m // {folds})), 0)::hugeint as d1 from strata),
rests as (
  select v0, v1, rest, row_number() over (order by v0 + v1 desc, v0 desc, v1 desc, rest) as n
  from (select v0, v1, unnest(range(0, m % {folds})) as rest from strata)),
dealt as (
  select 0::bigint as n, [d0 for f in {each}] as a, [d1 for f in {each}] as b, 0::bigint as v0, 0::bigint as v1,
    0::bigint as rest, -1::bigint as fold
  from totals
  union all
  select n, [a[f + 1] + case when f = fold then v0 else 0 end for f in {each}],
    [b[f + 1] + case when f = fold then v1 else 0 end for f in {each}], v0, v1, rest, fold
  from (
    select r.n, d.a, d.b, r.v0, r.v1, r.rest, best.f as fold
    from dealt d join rests r on r.n = d.n + 1, lateral (
      select f from (select unnest({each}) as f), totals
      order by r.v0 * (t0 - {folds} * d.a[f + 1]) * greatest(t1, 1) + r.v1 * (t1 - {folds} * d.b[f + 1]) * greatest(t0, 1) desc,
        d.a[f + 1] + d.b[f + 1], f limit 1) best)),
folds as (
  select key, cast(case when position <= m - m % {folds} then (position - 1) % {folds} else fold end as integer) as fold
  from ranked left join (select v0, v1, rest, fold from dealt where n > 0) d
    on d.v0 = ranked.v0 and d.v1 = ranked.v1 and d.rest = position - 1 - (m - m % {folds}))
"""


LONG_METRICS = """
with lm as (
  select l_returnflag as representation, l_linestatus as probe, l_linenumber as seed,
    cast(l_suppkey % 9 as varchar) as target,
    round(avg(l_quantity), 6) as roc_auc, round(avg(l_discount), 6) as average_precision, round(avg(l_tax), 6) as mae
  from lineitem group by all),
long as (
  select representation, probe, seed, target, 'roc_auc' as metric, 'functional' as task, roc_auc as value from lm
  union all select representation, probe, seed, target, 'average_precision', 'functional', average_precision from lm
  union all select representation, probe, seed, target, 'mae', 'descriptors', mae from lm)
"""

HISTORY = """
with hist as (
  select user_id % 5 as run, event_type as metric, cast(floor(event_id / 200) as bigint) as step, ts as logged, event_id, value
  from events)
"""
