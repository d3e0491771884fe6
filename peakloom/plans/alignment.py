"""Side tables, labels and embedding caches paired with records."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.functions.binding import pos_exploded
from peakloom.operators import align as A
from peakloom.plans.registry import query
from peakloom.plans.sql import CACHE, DOCS
from peakloom.plans.views import cache, doc_records, prop_labels, representations, table

SIDE = DOCS + """,
side as (select 'doc-' || l.doc_id as record_id, case when l.doc_id % 29 = 0 then 'other' else d.key end as key,
    case when l.doc_id % 7 = 0 then 'failed' else 'ok' end as status, quality, toxic
  from labels l join docs d on l.doc_id = d.doc_id
  union all select 'doc--1', 'none', 'ok', 0, 0)
"""


def _sidecar(spark, sf_dir):
    """Flags for part of the documents, with a few keys that disagree and a stranger."""
    doc = F.col("doc_id")
    side = table(spark, sf_dir, "labels").join(doc_records(spark, sf_dir).select("doc_id", "record_id", "key"), "doc_id").select(
        "record_id", F.when(doc % 29 == 0, "other").otherwise(F.col("key")).alias("key"),
        F.when(doc % 7 == 0, "failed").otherwise("ok").alias("status"), "quality", "toxic")
    stranger = spark.range(1).select(
        F.lit("doc--1").alias("record_id"), F.lit("none").alias("key"), F.lit("ok").alias("status"),
        F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    return side.unionByName(stranger)


@query("alignment_audit", SIDE + """
select count(*) filter (where s.record_id is null) as missing_property_rows, count(*) filter (where d.record_id is null) as missing_record_rows,
  0::bigint as repeated_record_ids, count(*) filter (where s.key <> d.key) as mismatched_keys
from docs d full join side s on d.record_id = s.record_id""")
def alignment_audit(spark, sf_dir):
    return A.alignment_audit(doc_records(spark, sf_dir), _sidecar(spark, sf_dir), "key")


@query("key_mismatches", SIDE + """select d.record_id, d.key as record_key, s.key as sidecar_key from docs d join side s on d.record_id = s.record_id where d.key <> s.key""")
def key_mismatches(spark, sf_dir):
    return A.key_mismatches(doc_records(spark, sf_dir), _sidecar(spark, sf_dir), "key")


@query("usable_pairs", SIDE + """select d.record_id, d.source, s.quality, s.toxic from docs d join side s on d.record_id = s.record_id where status = 'ok'""")
def usable_pairs(spark, sf_dir):
    side = _sidecar(spark, sf_dir).select("record_id", "status", "quality", "toxic")
    return A.usable_pairs(doc_records(spark, sf_dir).select("record_id", "source"), side, "status")


@query("descriptor_join", SIDE + """, one as (select record_id, min(quality) as quality from side group by record_id)
select 'doc-' || l.row_no as record_id, l.endpoint, o.quality from labs l left join one o on o.record_id = 'doc-' || l.row_no""")
def descriptor_join(spark, sf_dir):
    rows = prop_labels(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("row_no").cast("string")).alias("record_id"), "endpoint")
    return A.with_descriptors(rows, _sidecar(spark, sf_dir).select("record_id", "quality"))


@query("target_join", SIDE + """select d.record_id, d.key, s.quality from docs d join side s on d.record_id = s.record_id""")
def target_join(spark, sf_dir):
    return A.with_targets(doc_records(spark, sf_dir).select("record_id", "key"), _sidecar(spark, sf_dir).select("record_id", "quality"))


PAIRED_SQL = """
with s as (select doc_id, case when doc_id % 11 = 0 then 'failed' else 'ok' end as status, case when doc_id % 13 = 0 then 255 else 256 end as n,
  case when doc_id % 17 = 0 then 'x' else '' end as bad from documents)
select 'doc-' || doc_id as record_id, case when status <> 'ok' then 'status' when n <> 256 then 'fingerprint_length' else 'bit_string' end as reason
from s where status <> 'ok' or n <> 256 or bad <> ''"""


@query("paired_record_issues", PAIRED_SQL)
def paired_record_issues(spark, sf_dir):
    doc = F.col("doc_id")
    byte = F.repeat(F.lit("a"), F.when(doc % 13 == 0, 255).otherwise(256))
    bits = F.concat(F.repeat(F.lit("01"), F.lit(83)), F.when(doc % 17 == 0, "x").otherwise(""))
    side = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), doc.cast("string")).alias("record_id"),
        F.when(doc % 11 == 0, "failed").otherwise("ok").alias("rdkit_status"),
        F.to_binary(byte, F.lit("utf-8")).alias("morgan_ecfp4_2048"), bits.alias("maccs_keys_166_bits"))
    return A.paired_issues(side)


@query("common_records", CACHE + "select record_id from cache where vec_id % 10 not in (0, 1, 2)")
def common_records(spark, sf_dir):
    return A.common_records(representations(spark, sf_dir))


@query("common_records_by_split", CACHE + """
select case when vec_id % 4 = 0 then 'test' else 'train' end as split, count(*) as records from cache where vec_id % 10 not in (0, 1, 2) group by 1""")
def common_records_by_split(spark, sf_dir):
    split = F.when(F.col("vec_id") % 4 == 0, "test").otherwise("train")
    caches = {n: df.withColumn("split", split) for n, df in representations(spark, sf_dir).items()}
    return A.common_records(caches, ("split",)).groupBy("split").agg(F.count("*").alias("records"))


@query("concatenated_embeddings", CACHE + """, c as (select record_id, list_concat(embedding, list_transform(embedding, lambda x: x * 2)) as e from cache where vec_id % 10 not in (0, 1))
select record_id, len(e) as dimension, round(e[1]::double, 6) as first, round(e[65]::double, 6) as middle, round(e[128]::double, 6) as last from c""")
def concatenated_embeddings(spark, sf_dir):
    r = representations(spark, sf_dir, 2)
    r["r1"] = r["r1"].withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast("float")))
    both = A.concatenated(r)
    at = lambda i: F.round(F.element_at("embedding", i).cast("double"), 6)
    return both.select("record_id", F.size("embedding").cast("bigint").alias("dimension"),
                       at(1).alias("first"), at(65).alias("middle"), at(128).alias("last"))


COORD = CACHE + """,
x as (select record_id, vec_id, generate_subscripts(embedding, 1) as k, unnest(embedding)::double as v from cache),
st as (select k, avg(v) as m, stddev_pop(v) as s from x where vec_id % 4 <> 0 group by k)
"""


@query("coordinate_statistics", COORD + "select (k - 1)::integer as coordinate, round(m, 6) as mean, round(s, 6) as std from st")
def coordinate_statistics(spark, sf_dir):
    stats = A.coordinate_statistics(cache(spark, sf_dir).filter("vec_id % 4 <> 0"))
    pairs = F.arrays_zip("mean", "std")
    return stats.select(F.posexplode(pairs).alias("coordinate", "x")).select(
        "coordinate", F.round("x.mean", 6).alias("mean"), F.round("x.std", 6).alias("std"))


@query("standardized_embeddings", COORD + "select record_id, (k - 1)::integer as coordinate, round((v - m) / s, 5) as value from x join st using (k) where vec_id % 4 = 0")
def standardized_embeddings(spark, sf_dir):
    rows = cache(spark, sf_dir)
    scaled = A.standardized(rows.filter("vec_id % 4 = 0"), rows.filter("vec_id % 4 <> 0"))
    return pos_exploded(scaled, "record_id", items="embedding", pos="coordinate", name="v").select(
        "record_id", "coordinate", F.round("v", 5).alias("value"))


@query("manifest_issues", """
with m as (select 'v-' || vec_id as record_id, 'm' || (vec_id // 2) as molecule_id, case when vec_id % 90 = 0 then 'other' else 'train' end as split from embeddings)
select 'invalid_row' as issue, count(*) filter (where split = 'other') as rows from m
union all select 'repeated_record', count(*) - count(distinct record_id) from m
union all select 'repeated_molecule', count(*) - count(distinct molecule_id) from m""")
def manifest_issues(spark, sf_dir):
    v = F.col("vec_id")
    m = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v-"), v.cast("string")).alias("record_id"),
        F.concat(F.lit("m"), F.floor(v / 2).cast("string")).alias("molecule_id"),
        F.when(v % 90 == 0, "other").otherwise("train").alias("split"))
    return A.manifest_issues(m)
