"""Tables written to the shared scratch folder and read back through the guards."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from peakloom.operators import clean as C
from peakloom.operators import cohort
from peakloom.operators.conform import conform_shifts
from peakloom.plans.cleaning import AUDIT_SQL, POLICY
from peakloom.plans.cohorts import CLEANED
from peakloom.plans.conformance import ORDER_SQL, _orders, _peak_lists
from peakloom.plans.profiling import PER_RECORD
from peakloom.plans.registry import query
from peakloom.plans.splits import HELD
from peakloom.plans.sql import CACHE, DOCS, LONG_METRICS
from peakloom.plans.views import (
    cache, doc_records, line_peaks, long_metrics, pools, prop_labels, spectra, table,
)
from peakloom.session import scratch_path
from peakloom.sources import manifest, readers, writers
from peakloom.streaming.conform_stream import conform_new_files


@query("canonical_round_trip", PER_RECORD + """select source, count(*) as records, sum(n_h)::bigint as protons, sum(n_c)::bigint as carbons from rs group by source""")
def canonical_round_trip(spark, sf_dir):
    path = scratch_path(spark, "canonical")
    writers.write_canonical(spectra(spark, sf_dir), path, "orders", "lines", toolkit_version="1", rows_per_file=50_000)
    return readers.read_compatible(spark, [path])[0].groupBy("source").agg(
        F.count("*").alias("records"), F.sum(F.size("h_nmr_peaks")).alias("protons"), F.sum(F.size("c_nmr_peaks")).alias("carbons"))


@query("cleaned_pair", AUDIT_SQL + """select 'output_records' as name, (select count(*) from recs) - count(*) as n from removed
union all select 'removed_records', count(*) from removed
union all select 'input_records', count(*) from recs""")
def cleaned_pair(spark, sf_dir):
    """Both outputs of the cleaning sink; the counts come from the published tables."""
    cleaned, removed = scratch_path(spark, "cleaned"), scratch_path(spark, "removed")
    records = spectra(spark, sf_dir)
    writers.write_cleaned(records, cleaned, removed, ["orders", "lineitem"], POLICY)
    counts = {
        "output_records": spark.read.parquet(cleaned), "removed_records": spark.read.parquet(removed), "input_records": records,
    }
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("filtered_copy", AUDIT_SQL + "select source, count(*) as records from audit where record_id not in (select record_id from removed) group by source")
def filtered_copy(spark, sf_dir):
    path = scratch_path(spark, "kept")
    records = spectra(spark, sf_dir)
    writers.write_filtered(records, C.removals(records, POLICY, staged=True), path, keep=False, step="clean", inputs=["orders", "lineitem"])
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("records"))


@query("json_lines", DOCS + """select coalesce(case when doc_id % 10 = 1 then 'not an object' when doc_id % 10 = 2 then 'invalid JSON' end, 'ok') as state,
count(*) as lines from docs where doc_id % 10 <> 0 group by 1""")
def json_lines(spark, sf_dir):
    path = scratch_path(spark, "lines") + ".jsonl"
    doc = F.col("doc_id") % 10
    good = F.to_json(F.struct("record_id", "source", F.col("key").alias("smiles_canonical")))
    line = F.when(doc == 0, "  ").when(doc == 1, "[1, 2]").when(doc == 2, F.substring(good, 1, 20)).otherwise(good)
    doc_records(spark, sf_dir).select(line.alias("value")).write.text(path)
    rows = readers.read_jsonl(spark, path)
    return rows.groupBy(F.coalesce("problem", F.lit("ok")).alias("state")).agg(F.count("*").alias("lines"))


@query("split_files", """select case when o_custkey % 10 < 8 then 'train' when o_custkey % 10 = 8 then 'val' else 'test' end as split,
case when o_custkey % 10 < 8 then 0 when o_custkey % 10 = 8 then 1 else 2 end::integer as split_order, count(*) as records from orders group by all""")
def split_files(spark, sf_dir):
    root = scratch_path(spark, "splits")
    orders, k = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("o_custkey") % 10
    for name, chosen in (("train", k < 8), ("valid", k == 8), ("test", k == 9)):
        orders.filter(chosen).write.parquet(f"{root}/{name}.parquet")
    rows = readers.read_splits(spark, readers.resolve_splits(spark, root, ".parquet", require_all_splits=True))
    return rows.groupBy("split", "split_order").agg(F.count("*").alias("records"))


@query("property_csv", DOCS + """select "Drug", "Y" from (select key as "Drug", label as "Y" from labs)""")
def property_csv(spark, sf_dir):
    path = scratch_path(spark, "labels")
    prop_labels(spark, sf_dir).select(F.col("key").alias("Drug"), F.col("label").alias("Y")).write.csv(path, header=True)
    return readers.read_property_csv(spark, path, ["Drug", "Y"]).select("Drug", "Y")


@query("analytics_csv", """select o_orderpriority as source, count(*) as records, printf('%.8f', round(avg(o_totalprice), 4)) as mean_price, cast(null as varchar) as missing from orders group by 1""")
def analytics_csv(spark, sf_dir):
    path = scratch_path(spark, "analytics")
    summary = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg(
        F.count("*").alias("records"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.lit(None).cast("double").alias("missing"))
    writers.write_analytics_csv(summary, path)
    return spark.read.csv(path, header=True).withColumn("records", F.col("records").cast("bigint"))


@query("embedding_cache", CACHE + "select count(*) as records, count(distinct record_id) as ids, 64::bigint as dimension, (select count(*) from cache) as accepted from cache")
def embedding_cache(spark, sf_dir):
    path = scratch_path(spark, "embeddings")
    writers.write_embeddings(cache(spark, sf_dir).select("record_id", "embedding"), path, 64, {"model_name": "fixture"})
    rows, metadata = readers.read_embeddings(spark, path)
    return rows.agg(
        F.count("*").alias("records"), F.count_distinct("record_id").alias("ids"),
        F.max(F.size("embedding")).cast("bigint").alias("dimension"), F.lit(metadata["accepted_records"]).cast("bigint").alias("accepted"))


@query("metric_tables", LONG_METRICS + "select representation, probe, count(*) as rows, round(sum(roc_auc), 4) as total from lm group by all")
def metric_tables(spark, sf_dir):
    root = scratch_path(spark, "metrics")
    rows = long_metrics(spark, sf_dir)
    for name in ("A", "N", "R"):
        rows.filter(F.col("representation") == name).drop("representation").write.csv(f"{root}/{name}/test_metrics.csv", header=True)
    found = readers.read_metric_tables(spark, f"{root}/*", "*.csv", ["probe", "seed", "target", "roc_auc"])
    parent = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)
    return found.withColumn("representation", parent).groupBy("representation", "probe").agg(
        F.count("*").alias("rows"), F.round(F.sum("roc_auc"), 4).alias("total"))


@query("split_manifest", HELD + """select key as molecule_id, 'held' as split, 'r-' || key as record_id, 'pool' as source from held""")
def split_manifest(spark, sf_dir):
    """A manifest as the probe builder writes it; its selection is small by construction."""
    from peakloom.plans.splits import _held

    path = scratch_path(spark, "manifest") + ".json"
    chosen = [r["key"] for r in _held(spark, sf_dir).collect()]
    manifest.write_text(spark, path, json.dumps({"seed": 42, "records": [
        {"molecule_id": k, "split": "held", "record_id": f"r-{k}", "source": "pool"} for k in chosen]}))
    return readers.read_split_manifest(spark, path)


@query("cohort_tables", CLEANED + """select c.endpoint, c.split, count(*) as records, count(distinct c.key) as molecules
from con c join docs d on c.key = d.key where not discordant group by all""")
def cohort_tables(spark, sf_dir):
    labels, records = scratch_path(spark, "cohort-labels"), scratch_path(spark, "cohort-records")
    docs = doc_records(spark, sf_dir)
    expanded = cohort.expand(cohort.consolidate(cohort.drop_cross_split(prop_labels(spark, sf_dir))), docs)
    writers.write_cohorts(expanded, docs.select("record_id", "source"), labels, records)
    rows = spark.read.csv(labels, header=True)
    return rows.groupBy("endpoint", "split").agg(F.count("*").alias("records"), F.count_distinct("key").alias("molecules"))


@query("aligned_split_tables", HELD + """select case when key in (select key from held) then 'validation' else 'train' end as split, count(*) as records from bench group by 1""")
def aligned_split_tables(spark, sf_dir):
    from peakloom.operators.split import apply_holdout
    from peakloom.plans.splits import _held

    target, side_target = scratch_path(spark, "records"), scratch_path(spark, "side")
    bench = pools(spark, sf_dir)["bench"]
    side = bench.select("record_id", F.length("key").alias("flag"))
    assignment = apply_holdout(bench, _held(spark, sf_dir), "key")
    writers.write_aligned_splits(bench, side, assignment, target, side_target)
    return spark.read.parquet(side_target).groupBy("split").agg(F.count("*").alias("records"))


@query("incremental_conformance", ORDER_SQL + """
select 'plain:' || split || ':' || o.ok as record_id, count(lp.ok) filter (where nucleus = 'h') as protons, count(lp.ok) filter (where nucleus = 'c') as carbons
from o left join lp on o.ok = lp.ok where o.ok % 6 <> 0 group by 1""")
def incremental_conformance(spark, sf_dir):
    """Landing files conformed as a bounded stream; unreadable structures are set aside."""
    landing, done, refused, state = (scratch_path(spark, n) for n in ("landing", "accepted", "rejected", "state"))
    lists = _peak_lists(line_peaks(spark, sf_dir, by_order=True), F.col("shift"), F.col("shift"))
    rows = _orders(spark, sf_dir).join(lists, "ok", "left").select(
        "split", F.col("ok").alias("row_index"), F.when(F.col("ok") % 6 != 0, F.col("structure")).alias("smiles"),
        F.col("h_peaks").alias("h_shift"), F.col("c_peaks").alias("c_shift"))
    rows.write.parquet(landing)
    conform_new_files(spark, landing, rows.schema, lambda s: conform_shifts(s, "plain", "plain"), done, refused, state)
    return spark.read.parquet(done).select(
        "record_id", F.size("h_nmr_peaks").cast("bigint").alias("protons"), F.size("c_nmr_peaks").cast("bigint").alias("carbons"))
