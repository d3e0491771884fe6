"""Metrics, their aggregation over seeds and tasks, ranks and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.functions import text as X
from peakloom.functions.vectors import label_from_logit, sigmoid
from peakloom.operators import metrics as M
from peakloom.plans.profiling import rounded
from peakloom.plans.registry import query
from peakloom.plans.sql import HISTORY, LONG_METRICS, SCORES
from peakloom.plans.views import history, long_metrics, scores, table

REG_SQL = """
with p as (select l_returnflag as grp, l_quantity as y, l_extendedprice / 2000e0 as p from lineitem)
select grp, round(avg(abs(p - y)), 6) as mae, round(sqrt(avg((p - y) * (p - y))), 6) as rmse,
  round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) as r2 from p group by grp"""


def _predictions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 2000.0).alias("p"))


@query("regression_metrics", REG_SQL)
def regression_metrics(spark, sf_dir):
    return rounded(M.regression_metrics(_predictions(spark, sf_dir), "y", "p", ("grp",)))


LABELLED = SCORES + """, pr as (select *, (1 / (1 + exp(-(score - 48) / 20)) >= 0.5)::integer as predicted from sc),
k as (select lang, count(*) filter (where quality = 1 and predicted = 1) as tp, count(*) filter (where quality <> 1 and predicted = 1) as fp,
  count(*) filter (where quality = 1 and predicted <> 1) as fn, count(*) filter (where quality <> 1 and predicted <> 1) as tn from pr group by lang),
r as (select *, coalesce(tp / nullif(tp + fn, 0), 0) as rec, coalesce(tn / nullif(tn + fp, 0), 0) as spe from k)
select lang, tp, fp, fn, tn, round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy,
  round(case when tp + fn = 0 or tn + fp = 0 then rec + spe else (rec + spe) / 2 end, 6) as balanced_accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(rec, 6) as recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from r"""


@query("classification_metrics", LABELLED)
def classification_metrics(spark, sf_dir):
    logit = (F.col("score") - 48.0) / 20.0
    rows = scores(spark, sf_dir).withColumn("predicted", label_from_logit(logit))
    return rounded(M.classification_metrics(rows, "quality", "predicted", ("lang",)))


def ranking_sql(rows, by):
    group = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    return f"""
g as (select {group}score, count(*) filter (where y = 1) as p, count(*) filter (where y = 0) as n from {rows} group by all),
c as (select *, coalesce(sum(n) over ({part} order by score rows between unbounded preceding and 1 preceding), 0) as below,
    sum(p) over ({part} order by score desc) as hits, sum(p + n) over ({part} order by score desc) as called from g),
m as (select {group}sum(p)::bigint as positives, sum(p + n)::bigint as support,
    round(sum(p * (below + n / 2e0)) / nullif(sum(p) * sum(n), 0), 6) as roc_auc, round(sum(p * hits / called) / nullif(sum(p), 0), 6) as average_precision
  from c {'group by ' + by if by else ''})"""


@query("ranking_metrics", SCORES + ", rows as (select quality as y, score from sc)," + ranking_sql("rows", "") + " select * from m")
def ranking_metrics(spark, sf_dir):
    return rounded(M.ranking_metrics(scores(spark, sf_dir), "quality", "score"))


@query("ranking_metrics_large", """
with rows as (select l_returnflag as flag, (l_linestatus = 'O')::integer as y, l_extendedprice as score from lineitem),""" + ranking_sql("rows", "flag") + " select * from m")
def ranking_metrics_large(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), (F.col("l_linestatus") == "O").cast("int").alias("y"), F.col("l_extendedprice").alias("score"))
    return rounded(M.ranking_metrics(rows, "y", "score", ("flag",)))


@query("ranking_metrics_null_group", """
with rows as (select case when l_returnflag <> 'N' then l_returnflag end as flag, (l_linestatus = 'O')::integer as y, l_tax as score from lineitem),""" + ranking_sql("rows", "flag") + " select * from m")
def ranking_metrics_null_group(spark, sf_dir):
    """A null group is measured like any other."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"),
        (F.col("l_linestatus") == "O").cast("int").alias("y"), F.col("l_tax").alias("score"))
    return rounded(M.ranking_metrics(rows, "y", "score", ("flag",)))


@query("multi_target_metrics", SCORES + """, rows as (select 'quality' as target, quality as y, score from sc union all select 'toxic', toxic, score_toxic from sc),"""
       + ranking_sql("rows", "target") + " select *, round(positives / support, 6) as prevalence from m")
def multi_target_metrics(spark, sf_dir):
    return rounded(M.multi_target_metrics(scores(spark, sf_dir), {"quality": "score", "toxic": "score_toxic"}))


@query("score_probabilities", SCORES + "select doc_id, round(1 / (1 + exp(-(score - 48) / 20)), 6) as probability from sc")
def score_probabilities(spark, sf_dir):
    return scores(spark, sf_dir).select("doc_id", F.round(sigmoid((F.col("score") - 48.0) / 20.0), 6).alias("probability"))


def _long(spark, sf_dir):
    return M.wide_to_long(
        long_metrics(spark, sf_dir), ["representation", "probe", "seed", "target"],
        {"functional": ["roc_auc", "average_precision"], "descriptors": ["mae"]})


@query("wide_to_long", LONG_METRICS + "select * from long")
def wide_to_long(spark, sf_dir):
    return _long(spark, sf_dir)


@query("long_to_wide", LONG_METRICS + """select representation, probe, seed, max(value) filter (where target = '1' and metric = 'mae') as "1",
max(value) filter (where target = '2' and metric = 'mae') as "2" from long group by all""")
def long_to_wide(spark, sf_dir):
    rows = _long(spark, sf_dir).filter("metric = 'mae'")
    return M.long_to_wide(rows, ["representation", "probe", "seed"], "target", ["1", "2"], "value")


@query("seed_summary", LONG_METRICS + """
select representation, probe, task, target, metric, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, count(value) as n_seeds,
  min(value) as min, max(value) as max from long group by all""")
def seed_summary(spark, sf_dir):
    return rounded(M.seed_summary(_long(spark, sf_dir), ["representation", "probe", "task", "target", "metric"], "value"))


MACRO = LONG_METRICS + """,
ms as (select representation, probe, task, seed, metric, avg(value) as value from long where metric <> 'mae' group by all),
mac as (select representation, probe, task, metric, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, count(*) as n_seeds,
  round(min(value), 6) as min, round(max(value), 6) as max from ms group by all)
"""


@query("macro_summary", MACRO + "select * from mac")
def macro_summary(spark, sf_dir):
    return rounded(M.macro_summary(_long(spark, sf_dir)))


@query("macro_text", MACRO + "select representation, probe, task, metric, format('{:.4f}', mean) || ' ± ' || format('{:.4f}', std) as score from mac")
def macro_text(spark, sf_dir):
    table_ = rounded(M.macro_summary(_long(spark, sf_dir)))
    return table_.select("representation", "probe", "task", "metric", X.mean_sd_text(F.col("mean"), F.col("std"), F.col("n_seeds")).alias("score"))


@query("mean_ranks", LONG_METRICS + """,
pt as (select representation, probe, task, target, metric, round(avg(value), 6) as v from long group by all),
s as (select *, case when metric = 'mae' then v else -v end as sv from pt),
r as (select *, rank() over (partition by probe, task, target, metric order by sv) + (count(*) over (partition by probe, task, target, metric, sv) - 1) / 2 as rk from s)
select representation, probe, round(avg(rk), 6) as mean_rank, count(*) as n_metrics from r group by all""")
def mean_ranks(spark, sf_dir):
    per_target = M.seed_summary(_long(spark, sf_dir), ["representation", "probe", "task", "target", "metric"], "value")
    per_target = per_target.withColumn("mean", F.round("mean", 6))
    return rounded(M.mean_ranks(per_target))


PRODUCT_SCORES = """
with s as (select 'd' || (l_linenumber % 3) as dataset, l_linestatus as probe,
    case l_suppkey % 6 when 0 then 'a' when 1 then 'b' when 2 then 'a+x' when 3 then 'a+y' when 4 then 'b+x' else 'z' end as representation,
    round(avg(l_discount), 6) as score from lineitem group by all)
"""


def _endpoint_scores(spark, sf_dir):
    names = {0: "a", 1: "b", 2: "a+x", 3: "a+y", 4: "b+x", 5: "z"}
    return table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("d"), (F.col("l_linenumber") % 3).cast("string")).alias("dataset"), F.col("l_linestatus").alias("probe"),
        X.literal_map(names)[(F.col("l_suppkey") % 6).cast("int")].alias("representation"),
    ).agg(F.round(F.avg("l_discount"), 6).alias("score"))


@query("pool_ranks", PRODUCT_SCORES + """,
pools as (select 'all' as pool, unnest(['a', 'b', 'a+x', 'a+y', 'b+x', 'z']) as representation union all select 'plain', unnest(['a', 'b', 'z'])),
r as (select pool, dataset, probe, representation, rank() over w + (count(*) over (partition by pool, dataset, probe, score) - 1) / 2 as rk
  from s join pools using (representation) window w as (partition by pool, dataset, probe order by score desc))
select pool, probe, representation, round(avg(rk), 6) as mean_rank, count(distinct dataset) as n_endpoints from r group by all""")
def pool_ranks(spark, sf_dir):
    pools = {"all": ["a", "b", "a+x", "a+y", "b+x", "z"], "plain": ["a", "b", "z"]}
    return rounded(M.pool_ranks(_endpoint_scores(spark, sf_dir), pools))


BASE = PRODUCT_SCORES + """,
cmp as (select c.dataset, c.probe, c.representation, c.score, split_part(c.representation, '+', 1) as baseline from s c where c.representation like '%+%'),
del as (select cmp.*, b.score as baseline_score, round(cmp.score - b.score, 6) as delta, cmp.score - b.score > 0 as improved
  from cmp join s b on b.dataset = cmp.dataset and b.probe = cmp.probe and b.representation = cmp.baseline)
"""


@query("baseline_deltas", BASE + "select * from del")
def baseline_deltas(spark, sf_dir):
    return rounded(M.baseline_deltas(_endpoint_scores(spark, sf_dir), ["a", "b"]))


@query("best_combination", BASE + """select baseline, probe, dataset, max(score) as score, arg_min(representation, (-score, representation)) as representation from del group by all""")
def best_combination(spark, sf_dir):
    return M.best_per_group(M.baseline_deltas(_endpoint_scores(spark, sf_dir), ["a", "b"]), ["baseline", "probe", "dataset"], "score", ["representation"])


@query("paired_deltas", MACRO + """,
p as (select 'A-N' as comparison, 'A' as l, 'N' as r union all select 'R-N', 'R', 'N'),
d as (select comparison, a.probe, a.task, a.metric, a.value - b.value as x from p join ms a on a.representation = l
  join ms b on b.representation = r and a.probe = b.probe and a.task = b.task and a.metric = b.metric and a.seed = b.seed)
select comparison, probe, task, metric, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as std, count(*) as n_seeds, round(min(x), 6) as min, round(max(x), 6) as max
from d group by all""")
def paired_deltas(spark, sf_dir):
    per_seed = M.macro_per_seed(_long(spark, sf_dir))
    return rounded(M.paired_deltas(per_seed, {"A-N": ("A", "N"), "R-N": ("R", "N")}))


@query("selection_table", LONG_METRICS + "select representation, probe, task, seed, min(value) as value from long group by all")
def selection_table(spark, sf_dir):
    return M.selection_table(_long(spark, sf_dir), ["representation", "probe", "task", "seed"], ["value"])


@query("disagreements", """
select l_returnflag as grp, l_linenumber as line, case when count(distinct l_linestatus) > 1 then 'status' end as fields from lineitem group by all having count(distinct l_linestatus) > 1""")
def disagreements(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_linenumber").alias("line"), F.col("l_linestatus").alias("status"),
        F.col("l_linenumber").alias("same"))
    return M.disagreements(rows, ["grp", "line"], ["status", "same"])


@query("primary_scores", PRODUCT_SCORES + """select dataset, probe, representation, case when dataset = 'd0' then 'roc_auc' else 'r2' end as metric,
case when dataset = 'd0' then score else round(score * 2, 6) end as score from s""")
def primary_scores(spark, sf_dir):
    rows = _endpoint_scores(spark, sf_dir)
    name, value = X.primary_score(F.col("dataset"), ("d0",), F.col("score"), F.round(F.col("score") * 2, 6))
    return rows.select("dataset", "probe", "representation", name.alias("metric"), value.alias("score"))


@query("weighted_means", """
select o_orderpriority as source, round(sum(o_totalprice * (o_custkey % 4)) / sum(o_custkey % 4), 4) as weighted_mean, sum(o_custkey % 4)::bigint as weight
from orders group by 1 having sum(o_custkey % 4) > 0""")
def weighted_means(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("v"), (F.col("o_custkey") % 4).alias("w"))
    return rounded(M.weighted_means(rows, ["source"], "v", "w"), 4)


RANGES = """
with p as (select l_quantity * 0.5e0 - 6 as y, l_extendedprice / 4000e0 - 6 as p from lineitem),
b as (select *, least(greatest(cast(trunc((y + 5.5e0) / 1.275e0) as integer), 0), 19) as k from p),
g as (select k, count(*) as n, avg(abs(p - y)) as mae, avg((p - y) * (p - y)) as mse, avg(y) as my, avg(p) as mp from b group by k),
rng as (select r.range::integer as range_no, coalesce(n, 0) as count, round(mae, 6) as mae, round(mse, 6) as mse, round(my, 6) as mean_target,
  round(mp, 6) as mean_prediction, round(mp - my, 6) as bias from range(20) r left join g on g.k = r.range)
"""


def _range_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") * 0.5 - 6.0).alias("y"), (F.col("l_extendedprice") / 4000.0 - 6.0).alias("p"))
    return M.range_errors(rows, "y", "p", -5.5, 1.275, 20)


@query("range_errors", RANGES + "select * from rng")
def range_errors(spark, sf_dir):
    return rounded(_range_errors(spark, sf_dir))


@query("micro_macro_error", RANGES + "select round(sum(mae * n) / sum(n), 6) as micro_mae, round(avg(mae), 6) as macro_mae from g")
def micro_macro_error(spark, sf_dir):
    return rounded(M.micro_macro(_range_errors(spark, sf_dir)))


LATEST = HISTORY + ", lat as (select run, metric, step, arg_max(value, (logged, event_id)) as value from hist group by 1, 2, 3)"


def _latest(spark, sf_dir):
    return M.latest_per_step(history(spark, sf_dir), ["run", "metric"], "step", "logged", "value", "event_id")


@query("latest_per_step", LATEST + " select * from lat")
def latest_per_step(spark, sf_dir):
    return _latest(spark, sf_dir)


@query("last_steps_mean", LATEST + """, r as (select *, row_number() over (partition by run, metric order by step desc) as k from lat)
select run, metric, round(avg(value), 6) as mean_value, count(*) as steps from r where k <= 5 group by all""")
def last_steps_mean(spark, sf_dir):
    return rounded(M.last_steps_mean(_latest(spark, sf_dir), ["run", "metric"], "step", "value", 5))


@query("close_up", LATEST + " select * from lat where step >= (select max(step) from lat m where m.metric = lat.metric) - 10")
def close_up(spark, sf_dir):
    return M.close_up(_latest(spark, sf_dir), ["metric"], "step", 10).select("run", "metric", "step", "value")
