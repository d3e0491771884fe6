"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query is run
to completion into a sink that discards its rows; one small query warms up the
session first.
"""

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from peakloom.plans.catalog import QUERIES  # noqa: E402
from peakloom.session import local_session  # noqa: E402

HEADLINE = (
    "clean_removals", "clean_kept", "cleaned_pair", "inventory_by_source", "peak_summary",
    "annotation_completeness", "multiplicity_distribution", "table_profile", "source_reconciliation",
    "validation_issues", "dialect_issue_counts", "conform_rich_records", "conform_tokenised_carbons",
    "conform_atom_carbons", "decontaminate", "first_match_attribution", "transfer_train", "overlap_audit",
    "label_expansion", "fraction_split", "shared_holdout", "stratified_quota", "source_mixture",
    "alignment_audit", "common_records", "standardized_embeddings", "ranking_metrics_large", "macro_summary",
    "range_errors", "last_steps_mean", "cosine_range_errors", "encoder_protons", "masked_annotations",
)


def run(spark, name, sf_dir):
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "peakloom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "table_profile", sf_dir)
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
