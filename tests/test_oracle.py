"""A cross-section of the registered queries against DuckDB on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
CROSS_SECTION = """clean_removals clean_kept inventory_by_source peak_summary annotation_completeness multiplicity_distribution
table_profile source_reconciliation split_consistency validation_issues dialect_issue_counts conform_rich_peaks
conform_tokenised_protons conform_atom_peaks conform_shift_lists decontaminate first_match_attribution transfer_train
overlap_audit label_expansion fraction_split lowest_score_keys stratified_quota source_mixture alignment_audit
standardized_embeddings common_records ranking_metrics multi_target_metrics macro_summary mean_ranks range_errors
last_steps_mean encoder_protons tokenised_text capped_pairs masked_annotations incremental_conformance""".split()


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CROSS_SECTION) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == ["record_id", "removal_reason", "duplicate_of"]


@pytest.mark.parametrize("name", CROSS_SECTION)
def test_query_equals_sql(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    relation = tables.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(relation.columns)
    at = {c: i for i, c in enumerate(relation.columns)}
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[at[c]]) for c in order) for r in relation.fetchall()), key=repr)
    assert got == want
