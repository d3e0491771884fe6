"""Similarity pairs inside bounded blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.functions import vectors as V
from peakloom.operators import metrics as M
from peakloom.operators import pairs as P
from peakloom.plans.profiling import rounded
from peakloom.plans.registry import query
from peakloom.plans.sql import CACHE
from peakloom.plans.views import cache

SIZE, CAP = 16, 5

BLOCKS = CACHE + f""",
sc as (select *, substr(sha256('42' || chr(0) || record_id), 1, 16) as score from cache),
rn as (select *, substr(score, 1, 1) as bucket, row_number() over (partition by substr(score, 1, 1) order by score, record_id) - 1 as n from sc),
bl as (select *, bucket || '-' || (n // {SIZE}) as block_id, n % {SIZE} as block_row from rn),
pr as (select a.block_id, a.record_id as record_id_a, b.record_id as record_id_b, a.embedding as ea, b.embedding as eb
  from bl a join bl b on a.block_id = b.block_id and a.block_row < b.block_row),
cs as (select *, greatest(-1e0, least(1e0, list_dot_product(ea::double[], eb::double[]) / (sqrt(list_dot_product(ea::double[], ea::double[])) * sqrt(list_dot_product(eb::double[], eb::double[]))))) as cosine from pr)
"""


def _blocked(spark, sf_dir):
    return P.with_blocks(cache(spark, sf_dir), "record_id", SIZE, 42, digits=1)  # as the SQL cuts them, for any size


def _cosines(spark, sf_dir):
    pairs = P.pairs_within_blocks(_blocked(spark, sf_dir), "record_id", ["embedding"])
    return pairs.withColumn("cosine", V.cosine(F.col("embedding_a"), F.col("embedding_b")))


@query("blocks", BLOCKS + "select record_id, block_id, block_row from bl")
def blocks(spark, sf_dir):
    return _blocked(spark, sf_dir).select("record_id", "block_id", "block_row")


@query("cosine_pairs", BLOCKS + "select block_id, record_id_a, record_id_b, round(cosine, 6) as cosine from cs")
def cosine_pairs(spark, sf_dir):
    return _cosines(spark, sf_dir).select("block_id", "record_id_a", "record_id_b", F.round("cosine", 6).alias("cosine"))


@query("cosine_range_errors", BLOCKS + """,
b as (select least(greatest(cast(trunc((cosine + 1) / 0.2e0) as integer), 0), 9) as k, cosine as y, cosine * 0.9e0 as p from cs),
g as (select k, count(*) as n, avg(abs(p - y)) as mae, avg((p - y) * (p - y)) as mse, avg(y) as my, avg(p) as mp from b group by k)
select r.range::integer as range_no, coalesce(n, 0) as count, round(mae, 5) as mae, round(mse, 5) as mse, round(my, 5) as mean_target, round(mp, 5) as mean_prediction,
  round(mp - my, 5) as bias from range(10) r left join g on k = r.range""")
def cosine_range_errors(spark, sf_dir):
    rows = _cosines(spark, sf_dir).select(F.col("cosine").alias("y"), (F.col("cosine") * 0.9).alias("p"))
    return rounded(M.range_errors(rows, "y", "p", -1.0, 0.2, 10), 5)


@query("fingerprint_pairs", BLOCKS + """,
fp as (select *, len(list_filter(list_zip(ea, eb), lambda z: z[1] > 0 and z[2] > 0)) as both_on, len(list_filter(list_zip(ea, eb), lambda z: z[1] > 0 or z[2] > 0)) as any_on from pr)
select block_id, record_id_a, record_id_b, round(both_on / greatest(any_on, 1e-8), 6) as tanimoto from fp""")
def fingerprint_pairs(spark, sf_dir):
    blocked = _blocked(spark, sf_dir).withColumn("words", V.sign_words(F.col("embedding"), 64))
    pairs = P.pairs_within_blocks(blocked.drop("embedding"), "record_id", ["words"])
    similarity = V.tanimoto_words(F.col("words_a"), F.col("words_b"))
    return pairs.select("block_id", "record_id_a", "record_id_b", F.round(similarity, 6).alias("tanimoto"))


@query("capped_pairs", BLOCKS + f""",
b as (select *, least(greatest(cast(trunc(((cosine + 1) / 2) / 0.05e0) as integer), 0), 20) as similarity_bin from cs),
k as (select *, row_number() over (partition by block_id, similarity_bin order by sha256('42:pair:' || record_id_a || ':' || record_id_b)) as r from b)
select block_id, record_id_a, record_id_b, similarity_bin from k where r <= {CAP}""")
def capped_pairs(spark, sf_dir):
    pairs = _cosines(spark, sf_dir)
    kept = P.capped_per_bin(pairs, (F.col("cosine") + 1.0) / 2.0, 0.05, CAP, 42, ["record_id_a", "record_id_b"])
    return kept.select("block_id", "record_id_a", "record_id_b", "similarity_bin")
