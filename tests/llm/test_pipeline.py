"""Registered queries against their SQL or the contract, and the pipeline stage by stage."""

import hashlib
import itertools
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from peakloom.llm import catalog, near_copies, pii, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, tables, name):
    df, relation = entry.queries()[name](spark, SF), tables.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(relation.columns)
    at = {c: i for i, c in enumerate(relation.columns)}
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == sorted(
        (tuple(r[at[c]] for c in order) for r in relation.fetchall()), key=repr)


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_labels_reach_training_only(spark):
    rows = catalog.QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01").collect()
    labels = dict(duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and sum(p == y for p, y in judged) / len(judged) > 0.9


def test_held_out_quality(spark):
    rows = catalog.QUERIES["op8_quality"](spark, "/root/testdata/sf0.01").collect()
    labels = dict(duckdb.sql("select doc_id, quality from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and sum(p == y for p, y in judged) / len(judged) > 0.95


def first_of_each_group(texts):
    """Smallest ID of each group that similarities of 0.8 or more over five-word shingles connect; null is like null only."""
    sets = {i: None if t is None else near_copies.shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    for i, j in itertools.combinations(sorted(sets), 2):
        both = (sets[i], sets[j])
        alike = both[0] is both[1] if None in [type(b) is np.ndarray or None for b in both] else near_copies.similarity(*both) >= 0.8
        if alike and root[i] != root[j]:
            low, high = sorted((root[i], root[j]))
            root = {k: low if r == high else r for k, r in root.items()}
    return set(root.values())


def test_stages_against_brute_force(spark, tables):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        kept[name] = (before, [r.asDict() for r in docs.collect()])
        assert name == "bpe" or docs.columns == columns
    before, after = kept["near_duplicates"]
    assert {r["doc_id"] for r in after} == first_of_each_group({b[0]: b[1] for b in before})
    before, after = kept["decontamination"]
    bad = {r[0] for r in tables.sql(f"select doc_id from ({catalog.CONTAMINATION_SQL}) where contaminated").fetchall()}
    assert {r["doc_id"] for r in after} == {b[0] for b in before} - bad
    before, after = kept["pii"]
    assert {r["doc_id"]: r["text"] for r in after} == {b[0]: pii.redacted(b[1], pii.find_spans(b[1])) for b in before}
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = kept["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {b[0]: b[1] for b in before}
    for r in after:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_quality_stage_keeps_good_documents(spark, tables):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, SF).select("doc_id").collect()}
    good = [r[0] for r in tables.sql("select doc_id from labels join documents using (doc_id) where quality = 1").fetchall()]
    assert len(left & set(good)) >= 0.97 * len(good)
    assert quality.FEATURES


def test_texts_are_encoded_once(spark):
    """One Python function in the plan, called once a row, gives the IDs and both digests."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (catalog.QUERIES["op9_word_bpe"](spark, SF), corpus_pipeline.encode(spark, docs, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.count("coded(text") == 1


def test_clashing_columns_keep_their_values(spark, tmp_path):
    schema = "doc_id long, text string, _row string, ids string, `a b` int, m map<string,int>"
    docs = spark.createDataFrame([(1, "some words here", "mine", "own", 7, {"k": 1}), (None, None, "two", None, None, None)], schema)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "unrelated")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    coded = {r.doc_id: r.asDict() for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert coded[None]["ids"] == [] and coded[1]["n_tokens"] == len(coded[1]["ids"]) and set(coded[1]) == {
        "doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_odd_documents_pass_every_stage(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b", "en", "s", 3), (None, None, None, None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    for n, data in (("some", rows), ("none", [])):
        base = os.path.join(folder, n)
        spark.createDataFrame(data, schema).write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "x y")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        found = corpus_pipeline.run(spark, base).collect()
        assert len(found) == (3 if data else 0)
