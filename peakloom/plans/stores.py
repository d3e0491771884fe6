"""Bucketed tables, bitmap prefilters, sketches and the maintained index, against the same SQL as the plain forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.operators import align as A
from peakloom.operators import cohort as C
from peakloom.operators import overlap as O
from peakloom.operators import sketches as S
from peakloom.plans.overlaps import HITS, MOVED
from peakloom.plans.registry import query
from peakloom.plans.sql import CACHE, DOCS, POOLS
from peakloom.plans.views import all_labels, doc_records, pools, representations
from peakloom.session import cut_lineage, scratch_path
from peakloom.sources import buckets, index_store


@query("bucketed_common_records", CACHE + """select record_id, len(embedding) as dimension, round(embedding[1]::double, 6) as first
from cache where vec_id % 10 not in (0, 1, 2)""")
def bucketed_common_records(spark, sf_dir):
    """The cohort of three embedding caches, stored in buckets of the record ID and joined where they lie."""
    stored = {}
    for name, df in representations(spark, sf_dir).items():
        target = scratch_path(spark, f"bucketed-{name}")
        buckets.write_bucketed(df.select("record_id", "embedding"), target, "record_id", 8)
        stored[name] = buckets.read_bucketed(spark, target)
    joined = A.joined_embeddings(stored)
    return joined.select(
        "record_id", F.size("r0_embedding").alias("dimension"), F.round(F.col("r2_embedding")[0].cast("double"), 6).alias("first"))


@query("decontaminate_prefiltered", HITS + "select * from bench where key not in (select key from hits)")
def decontaminate_prefiltered(spark, sf_dir):
    p = pools(spark, sf_dir)
    return O.decontaminate(p["bench"], O.near_keys([p["a"], p["b"]], p["bench"], "key"), "key").select("record_id", "key", "source")


@query("matched_keys_prefiltered", POOLS + "select distinct key from pool_a where key in (select key from bench)")
def matched_keys_prefiltered(spark, sf_dir):
    p = pools(spark, sf_dir)
    return O.matched_keys(p["bench"], p["a"], "key", prefilter=True)


@query("transfer_prefiltered", MOVED + "select * from pool_t union all select * from moved")
def transfer_prefiltered(spark, sf_dir):
    p = pools(spark, sf_dir)
    return O.transfer(p["bench"], O.near_keys([p["d"]], p["bench"], "key")[0], p["t"], "key")[1]


@query("attribution_prefiltered", HITS + """, n as (select o, count(*) as c from hits where key in (select key from bench) group by o)
select 'a' as comparison, coalesce((select c from n where o = 0), 0) as new_molecules
union all select 'b', coalesce((select c from n where o = 1), 0)""")
def attribution_prefiltered(spark, sf_dir):
    p = pools(spark, sf_dir)
    near = O.near_keys([p["a"], p["b"]], p["bench"], "key")
    return O.attribution(p["bench"], dict(zip(("a", "b"), near, strict=True)), "key")


WHOLE = DOCS + """,
labs_all as (
  select lang as endpoint, case when doc_id % 5 = 0 then 'test' else 'train_val' end as split, substr(hk, 1, 2) || '-' || hk as key,
    case when doc_id % 3 = 0 then null when doc_id % 4 < 2 then cast(doc_id % 2 as varchar) else (doc_id % 2) || '.00' end as label, doc_id as row_no
  from dk),
idx_all as (select key, substr(key, 1, 2) as connectivity, arg_min(lang, doc_id) as representative, count(*) as record_count from docs group by key)
"""


@query("cross_split_keys_whole", WHOLE + """select endpoint, key from labs_all group by endpoint, key having count(distinct split) > 1""")
def cross_split_keys_whole(spark, sf_dir):
    """Keys on both sides of a split, over all documents; unlabelled ones have a null label."""
    return C.cross_split_keys(all_labels(spark, sf_dir)).select("endpoint", "key")


@query("overlap_details_whole", WHOLE + """
select l.endpoint, l.split, l.key, l.label, l.row_no, i.connectivity, i.representative, i.record_count from labs_all l join idx_all i on l.key = i.key""")
def overlap_details_whole(spark, sf_dir):
    """Every document's property row with what an index of all documents knows, the index cut to near keys first."""
    properties = all_labels(spark, sf_dir)
    index = O.identity_index(doc_records(spark, sf_dir), "key", "lang", "doc_id")
    return O.overlap_details(properties, O.near_keys([cut_lineage(index)], properties, "key")[0], "key")


@query("maintained_index", WHOLE + "select * from idx_all")
def maintained_index(spark, sf_dir):
    """An index built from one half of the documents, with the other half merged into it."""
    docs, target = doc_records(spark, sf_dir), scratch_path(spark, "index")
    second = F.col("doc_id") % 2 == 0
    index_store.write_index(docs.filter(~second), target, "key", "lang", "doc_id", parts=16)
    index_store.merge_index(docs.filter(second), target, "lang", "doc_id", "second")
    return index_store.read_index(spark, target).drop("first_row")


PAIRS = [("en", "de"), ("en", "fr"), ("en", "es"), ("de", "fr")]


@query("sketch_overlaps", DOCS + """, p as (select * from (values ('en', 'de'), ('en', 'fr'), ('en', 'es'), ('de', 'fr')) t("left", "right"))
select "left", "right", (select count(*) from (select key from docs where lang = "left" intersect select key from docs where lang = "right")) as keys,
  true as within from p where "left" in (select lang from docs) and "right" in (select lang from docs)""")
def sketch_overlaps(spark, sf_dir):
    """Keys shared by languages: the exact number, and whether the estimate from the sketches is within its bound."""
    docs = doc_records(spark, sf_dir).select("lang", "key")
    found = S.overlap_estimates(cut_lineage(S.key_sketches(docs, "lang", "key")), "lang", PAIRS)
    pair = F.explode(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in PAIRS])).alias("p")
    sides = docs.distinct().select("lang", "key", pair).filter((F.col("lang") == F.col("p.left")) | (F.col("lang") == F.col("p.right")))
    both = sides.groupBy("p.left", "p.right", "key").agg(F.count("*").alias("n"))
    exact = both.groupBy("left", "right").agg(F.count_if(F.col("n") == 2).alias("keys"))
    return exact.join(found, ["left", "right"]).select(
        "left", "right", "keys", S.bounded(F.col("estimate"), F.col("keys"), F.col("bound")).alias("within"))


@query("sketch_unions", DOCS + "select count(distinct key) as keys, count(distinct case when lang in ('en', 'de') then key end) as two_languages, true as within, true as two_within from docs")
def sketch_unions(spark, sf_dir):
    """Distinct keys of all and of some languages: exact, and whether the merged sketches come near."""
    docs = doc_records(spark, sf_dir).select("lang", "key")
    stored = cut_lineage(S.key_sketches(docs, "lang", "key"))
    two = F.col("lang").isin("en", "de")
    estimates = {"every": S.union_estimate(stored), "some": S.union_estimate(stored.filter(two))}
    exact = docs.agg(F.count_distinct("key").alias("keys"), F.count_distinct(F.when(two, F.col("key"))).alias("two_languages"))
    for name, one in estimates.items():
        exact = exact.withColumn(name, one.scalar())
    return exact.select(
        "keys", "two_languages", S.bounded(F.col("every"), F.col("keys"), S.hll_bound(F.col("keys"))).alias("within"),
        S.bounded(F.col("some"), F.col("two_languages"), S.hll_bound(F.col("two_languages"))).alias("two_within"))
