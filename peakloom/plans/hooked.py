"""User hooks in Arrow batches and linear probes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.operators import hooks as H
from peakloom.operators.conform import conform_shifts
from peakloom.operators.dialects import dialect_issues
from peakloom.operators.folds import fold_shares, group_folds
from peakloom.operators.probe import fold_moments, prepared, run_probe
from peakloom.plans.features import TOK_OK
from peakloom.plans.registry import query
from peakloom.plans.sql import DOCS
from peakloom.plans.sql import group_folds as group_folds_sql
from peakloom.plans.views import cache, doc_records, spectra, table


def _count_lines(text):
    if "@" in text:
        return None
    if "&&&" in text:
        raise ValueError("unreadable line")
    return {"n_lines": text.count("\n") + 1}


@query("status_hook", """
select 'doc-' || doc_id as record_id, case when doc_id % 23 = 0 then 'missing_smiles' when contains(text, '@') then 'invalid_smiles' when contains(text, '&&&') then 'calculation_error' else 'ok' end as status,
  case when doc_id % 23 <> 0 and not contains(text, '@') and not contains(text, '&&&') then length(text) - length(replace(text, chr(10), '')) + 1 end as n_lines from documents""")
def status_hook(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("record_id"),
        F.when(F.col("doc_id") % 23 != 0, F.col("text")).alias("text"))
    fields = T.StructType([T.StructField("n_lines", T.LongType())])
    return H.with_status(rows, "text", _count_lines, fields).select("record_id", "status", "n_lines")


@query("key_hook", DOCS + """select 'plain:' || source || ':' || doc_id as record_id, substr(key, 1, 2) as smiles_canonical from docs""")
def key_hook(spark, sf_dir):
    none = F.array().cast("array<double>")
    landing = doc_records(spark, sf_dir).select(
        F.col("source").alias("split"), F.col("doc_id").alias("row_index"), F.col("key").alias("smiles"),
        none.alias("h_shift"), none.alias("c_shift"))
    hook = H.key_hook(lambda text: text.split("-")[0])
    return conform_shifts(landing, "plain", "plain", structure=hook).select("record_id", "smiles_canonical")


def _encode(batch):
    return [[float(len(h)), float(len(c))] for h, c in zip(batch["h"], batch["c"])]


def _embedded(spark, sf_dir):
    records = spectra(spark, sf_dir).withColumns({
        "h": F.transform("h_nmr_peaks", lambda p: p["shift"]), "c": F.transform("c_nmr_peaks", lambda p: p["shift"])})
    return H.embed(records, dialect_issues("tokenised", strict=False), _encode, ["h", "c"])


@query("embed_hook", TOK_OK + """select record_id, count(*) filter (where nucleus = 'h')::double as first, count(*) filter (where nucleus = 'c')::double as second from okt group by 1""")
def embed_hook(spark, sf_dir):
    embedded, _ = _embedded(spark, sf_dir)
    return embedded.select("record_id", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.get("embedding", F.lit(1)).cast("double").alias("second"))


@query("embed_hook_rejections", TOK_OK + "select record_id from recs where record_id not in (select record_id from okt)")
def embed_hook_rejections(spark, sf_dir):
    return _embedded(spark, sf_dir)[1].select("record_id")


def _probe_rows(spark, sf_dir):
    return cache(spark, sf_dir).withColumns({
        "molecule": F.concat(F.lit("m"), F.floor(F.col("vec_id") / 2).cast("string")),
        "positive": (F.col("label") < 5).cast("int")})


@query("ridge_probe")
def ridge_probe(spark, sf_dir):
    rows = _probe_rows(spark, sf_dir)
    return run_probe(rows.filter("vec_id % 4 <> 0"), rows.filter("vec_id % 4 = 0"), y="label", group="molecule",
                     task="regression")


@query("logistic_probe")
def logistic_probe(spark, sf_dir):
    rows = _probe_rows(spark, sf_dir)
    return run_probe(rows.filter("vec_id % 4 <> 0"), rows.filter("vec_id % 4 = 0"), y="positive", group="molecule",
                     task="classification")


FOLD_GROUPS = """select 'm' || (vec_id // 2) as key, count(*) filter (where not coalesce(label < 5, false)) as v0,
  count(*) filter (where coalesce(label < 5, false)) as v1 from embeddings group by 1"""


@query("stratified_group_folds", group_folds_sql(FOLD_GROUPS, 5, 42) + "select key, fold from folds")
def stratified_group_folds(spark, sf_dir):
    return group_folds(_probe_rows(spark, sf_dir).withColumnRenamed("molecule", "key"), "key", 5, 42, "positive")


GRAM_GROUPS = "select 'm' || (vec_id // 2) as key, 0::bigint as v0, count(*) as v1 from embeddings group by 1"


@query("probe_gram_sums", group_folds_sql(GRAM_GROUPS, 5, 42) + """,
z as (
  select vec_id, fold, list_concat([1e0], [cast(x as double) for x in embedding], [cast(label as double)]) as z
  from embeddings join folds on key = 'm' || (vec_id // 2)),
cells as (select fold, z, i, unnest(range(i, len(z))) as j from (select fold, z, unnest(range(0, len(z))) as i from z))
select fold, cast(i as integer) as i, cast(j as integer) as j, round(sum(z[i + 1] * z[j + 1]), 6) as total from cells group by all""")
def probe_gram_sums(spark, sf_dir):
    """Sums of products per fold, from which the ridge search fits and scores every model."""
    rows = _probe_rows(spark, sf_dir)
    width = len(rows.select("embedding").first()["embedding"])
    sums = fold_moments(prepared(rows, "label", "molecule", group_folds(rows, "molecule", 5, 42)), width)
    return sums.withColumn("total", F.round("total", 6))


@query("probe_fold_shares", group_folds_sql(FOLD_GROUPS, 5, 42) + """
select fold, case when label < 5 then 1 else 0 end as positive, count(*) as rows, count(distinct key) as groups
from embeddings join folds on key = 'm' || (vec_id // 2) group by 1, 2""")
def probe_fold_shares(spark, sf_dir):
    rows = _probe_rows(spark, sf_dir)
    return fold_shares(rows, group_folds(rows, "molecule", 5, 42, "positive"), "molecule", "positive")
