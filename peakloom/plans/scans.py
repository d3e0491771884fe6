"""Scans that keep an order, guards, reports and logs, written and read back."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from peakloom.operators import validate as V
from peakloom.operators.profile import plot_ranges
from peakloom.operators.quantiles import exact_quantiles
from peakloom.plans.profiling import rounded
from peakloom.plans.registry import query
from peakloom.plans.sql import DOCS
from peakloom.plans.validation import ISSUES_SQL
from peakloom.plans.views import doc_records, spectra, table
from peakloom.schema import CANONICAL
from peakloom.session import scratch_path
from peakloom.sources import manifest, readers, writers


@query("ordered_scan", DOCS + """, t as (select record_id, source, doc_id, case when lang in ('en', 'de') then 0 else 1 end as file_no from docs)
select record_id, lag(record_id) over (partition by source order by file_no, doc_id) as previous, true as peaks_missing from t""")
def ordered_scan(spark, sf_dir):
    """Records of several tables in the order of their files and rows; absent fields are null."""
    docs, paths = doc_records(spark, sf_dir), []
    first = F.col("lang").isin("en", "de")
    for i, part in enumerate((first, ~F.coalesce(first, F.lit(False)))):
        paths.append(scratch_path(spark, f"scan-{i}"))
        docs.filter(part).orderBy("doc_id").select("record_id", "source").write.parquet(paths[-1])
    order = Window.partitionBy("source").orderBy(*readers.ROW_ORDER)
    return readers.read_records(spark, paths, ordered=True).select(
        "record_id", F.lag("record_id").over(order).alias("previous"), F.col("h_nmr_peaks").isNull().alias("peaks_missing"))


@query("in_memory_source", DOCS + "select 'all-' || source as record_id, count(*) as records from docs group by source")
def in_memory_source(spark, sf_dir):
    """One record per source, held by the caller, and how many documents are matched to it."""
    docs = doc_records(spark, sf_dir)
    sources = [r["source"] for r in docs.select("source").distinct().collect()]
    blank = dict.fromkeys(CANONICAL.names)
    held = readers.in_memory_records(spark, [{**blank, "record_id": f"all-{s}", "source": s} for s in sources])
    return docs.select("source").join(held.select("record_id", "source"), "source").groupBy("record_id").agg(F.count("*").alias("records"))


@query("property_sidecar_scan", DOCS + "select record_id, key as smiles_canonical, 'ok' as status, n_chars from docs")
def property_sidecar_scan(spark, sf_dir):
    path = scratch_path(spark, "sidecar")
    doc_records(spark, sf_dir).select(
        "record_id", F.col("key").alias("smiles_canonical"), F.lit("ok").alias("status"), "n_chars", "lang").write.parquet(path)
    return readers.read_properties(spark, path, ["n_chars"], status="status")


@query("input_by_suffix", DOCS + """select 'jsonl' as kind, record_id, source from docs
union all select 'jsonl first', * from (select record_id, source from docs order by doc_id limit 300)
union all select 'parquet first', * from (select record_id, source from docs order by doc_id limit 300)""")
def input_by_suffix(spark, sf_dir):
    """The same records as JSON lines and as a table, whole and the first ones in file order."""
    docs = doc_records(spark, sf_dir).orderBy("doc_id").select("record_id", "source")
    lines, rows = scratch_path(spark, "records") + ".jsonl", scratch_path(spark, "records")
    docs.write.json(lines)
    docs.write.parquet(rows)
    parts = {"jsonl": (lines, None), "jsonl first": (lines, 300), "parquet first": (rows, 300)}
    found = [readers.read_any(spark, p, n).select(F.lit(kind).alias("kind"), "record_id", "source") for kind, (p, n) in parts.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("stage_report", """select 'documents' as name, count(*) as records from documents union all select 'sources', count(distinct source) from documents
union all select 'labels', count(*) from labels""")
def stage_report(spark, sf_dir):
    """Counts of a stage, written as its report and read back."""
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources")).first()
    counts = {**docs.asDict(), "labels": table(spark, sf_dir, "labels").count()}
    path = scratch_path(spark, "report") + ".json"
    manifest.write_report(spark, path, manifest.stage_report("inventory", {"documents": sf_dir}, {}, counts))
    report = json.loads(manifest.read_text(spark, path))
    return spark.createDataFrame(list(report["counts"].items()), "name string, records long")


@query("rejection_log", DOCS + """select record_id, key as source_smiles, case when n_chars > 5000 then 'too long' else 'multiple of seven' end as reason
from docs where n_chars > 5000 or doc_id % 7 = 0""")
def rejection_log(spark, sf_dir):
    """Rejected records with their reason, as JSON lines."""
    reason = F.when(F.col("n_chars") > 5000, "too long").when(F.col("doc_id") % 7 == 0, "multiple of seven")
    judged = doc_records(spark, sf_dir).select("record_id", F.col("key").alias("source_smiles"), reason.alias("reason"))
    path = scratch_path(spark, "rejections")
    writers.write_rejections(judged.filter(F.col("reason").isNotNull()), path)
    return spark.read.schema("record_id string, source_smiles string, reason string").json(path)


@query("checked_records", ISSUES_SQL + """select source, count(*) as records from recs where record_id not in (select record_id from found) group by source""")
def checked_records(spark, sf_dir):
    """Records that pass the check which fails the job at the first invalid one."""
    sound = V.validate(spectra(spark, sf_dir)).filter(F.size("issues") == 0).drop("issues")
    return V.checked(sound).groupBy("source").agg(F.count("*").alias("records"))


@query("quartile_ranges", """select l_returnflag as flag, l_linenumber as line_no, count(l_extendedprice) as n, round(quantile_cont(l_extendedprice, 0.25), 6) as q1,
round(quantile_cont(l_extendedprice, 0.5), 6) as median, round(quantile_cont(l_extendedprice, 0.75), 6) as q3 from lineitem group by 1, 2""")
def quartile_ranges(spark, sf_dir):
    """Exact quartiles of every group of a whole table."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line_no"), F.col("l_extendedprice").alias("v"))
    found = exact_quantiles(rows, "v", [0.25, 0.5, 0.75], ("flag", "line_no"))
    q = {name: F.round(F.col("quantiles")[i], 6).alias(name) for i, name in enumerate(("q1", "median", "q3"))}
    return found.select("flag", "line_no", "n", *q.values())


@query("plot_ranges_whole", """
with s as (select o_orderpriority as source, o_totalprice as v from orders),
q as (select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from s),
b as (select q1 - 0.5e0 * (q3 - q1) as lower, q3 + 0.5e0 * (q3 - q1) as upper from q)
select source, count(*) as values, count(*) filter (where v between lower and upper) as values_in_range,
  round(min(v) filter (where v between lower and upper), 4) as shown_min, round(max(v) filter (where v between lower and upper), 4) as shown_max,
  round(max(lower), 4) as lower, round(max(upper), 4) as upper from s, b group by source""")
def plot_ranges_whole(spark, sf_dir):
    """Ranges around the quartiles of all values, no sample taken."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("v"))
    return rounded(plot_ranges(rows, "source", "v", whiskers=0.5), 4)
