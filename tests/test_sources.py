import json

import pytest

from conftest import record
from peakloom.operators import align as A
from peakloom.schema import SIDECAR
from peakloom.session import scratch_path
from peakloom.sources import manifest as M
from peakloom.sources import readers as R
from peakloom.sources import writers as W


def test_canonical_guards(spark, records, tmp_path):
    good, other = scratch_path(spark, "good"), scratch_path(spark, "other")
    assert W.write_canonical(records([record("a"), record("b")]), good, "s", "c", toolkit_version="1") == 2
    assert R.read_canonical(spark, good, toolkit_version=True).count() == 2
    with pytest.raises(FileExistsError):
        W.write_canonical(records([record("a")]), good, "s", "c")
    W.write_canonical(records([record("a")]), other, "s", "c", toolkit_version="2")
    with pytest.raises(ValueError, match="different toolkit versions"):
        R.read_compatible(spark, [good, other])
    with pytest.raises(ValueError, match="no input"):
        R.read_compatible(spark, [])
    M.write_manifest(spark, good, {"canonical_schema_version": "1"}, overwrite=True)
    with pytest.raises(ValueError, match="version"):
        R.read_canonical(spark, good)
    strange = str(tmp_path / "strange")
    spark.range(1).write.parquet(strange)
    M.write_manifest(spark, strange, {"canonical_schema_version": "2"})
    with pytest.raises(ValueError, match="schema"):
        R.read_canonical(spark, strange)


def test_records_with_missing_fields_and_order(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.createDataFrame([(f"r{i}", i) for i in range(20)], "record_id string, extra int").coalesce(1).write.parquet(path)
    assert [r.record_id for r in R.read_any(spark, path, max_records=3).collect()] == ["r0", "r1", "r2"]
    assert R.read_records(spark, [path, path]).count() == 40
    spark.range(2).write.parquet(str(tmp_path / "n"))
    with pytest.raises(ValueError, match="no record_id"):
        R.read_records(spark, [str(tmp_path / "n")])
    with pytest.raises(ValueError, match="unique"):
        R.in_memory_records(spark, [record("a"), record("a")])


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"record_id": "a", "h_nmr_peaks": [{"shift": 1.5}]}\n\n  \n[1]\n{"record_id": \n')
    rows = R.read_jsonl(spark, str(path)).collect()
    assert [(r.record_id, r.problem) for r in rows] == [("a", None), (None, "not an object"), (None, "invalid JSON")]
    assert rows[0].h_nmr_peaks[0].shift == 1.5
    with pytest.raises(Exception, match="not an object"):
        R.readable_jsonl(spark, str(path)).collect()


def test_property_csv_guards(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Drug,Y\nCC,01.0\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Drug,record_id\nCC,1\n")
    assert R.read_property_csv(spark, str(tmp_path / "a.csv"), ["Drug", "Y"]).collect() == [("CC", "01.0")]
    with pytest.raises(ValueError, match="lacks"):
        R.read_property_csv(spark, str(tmp_path / "a.csv"), ["Z"])
    with pytest.raises(ValueError, match="record_id"):
        R.read_property_csv(spark, str(tmp_path / "b.csv"), [])


def test_split_files(spark, tmp_path):
    for name in ("train", "val"):
        spark.range(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert list(R.resolve_splits(spark, str(tmp_path), ".parquet")) == ["train", "val"]
    with pytest.raises(FileNotFoundError):
        R.resolve_splits(spark, str(tmp_path), ".parquet", require_all_splits=True)
    spark.range(2).write.parquet(str(tmp_path / "all.parquet"))
    assert list(R.resolve_splits(spark, str(tmp_path), ".parquet", prefer_all=True)) == ["all"]


def test_embedding_and_property_guards(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "record_id string, embedding array<float>")
    with pytest.raises(Exception, match="unusable vector of b"):
        W.write_embeddings(rows, str(tmp_path / "e"), 2, {})
    twice = rows.filter("record_id = 'a'").unionByName(rows.filter("record_id = 'a'"))
    W.write_embeddings(twice, str(tmp_path / "f"), 2, {"model_name": "m"}, rejected=3)
    with pytest.raises(ValueError, match="repeats a record_id"):
        R.read_embeddings(spark, str(tmp_path / "f"))
    assert M.read_manifest(spark, str(tmp_path / "f"))["rejected_records"] == 3
    spark.createDataFrame([("a", "k", "ok"), ("b", "k", "failed")], "record_id string, smiles_canonical string, rdkit_status string").write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="not ok"):
        R.read_properties(spark, str(tmp_path / "p"), [])


def test_metric_tables_name_their_directory(spark, tmp_path):
    for name in ("model a", "b+c"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m.csv").write_text("probe,seed\nlinear,42\n")
    found = R.read_metric_tables(spark, str(tmp_path), "m.csv", ["probe", "seed"])
    assert sorted((r.representation, r.seed) for r in found.collect()) == [("b+c", 42), ("model a", 42)]
    with pytest.raises(ValueError, match="lack"):
        R.read_metric_tables(spark, str(tmp_path), "m.csv", ["auc"])


def test_cohort_tables_are_tagged(spark, tmp_path):
    for e in ("x", "y"):
        spark.range(2).write.parquet(str(tmp_path / e / "test.parquet"))
    rows = R.read_cohorts(spark, str(tmp_path), ["x", "y"], ["test"]).groupBy("endpoint", "split").count()
    assert sorted(map(tuple, rows.collect())) == [("x", "test", 2), ("y", "test", 2)]


def test_split_manifest_and_rejections(spark, tmp_path):
    rows = [{"split": "train", "record_id": "a", "molecule_id": "m", "source": "s"},
            {"split": "validation", "record_id": "a", "molecule_id": "n", "source": "s"},
            {"split": "other", "record_id": "b", "molecule_id": "m", "source": "s"}]
    path = str(tmp_path / "m.json")
    M.write_text(spark, path, json.dumps({"seed": 1, "records": rows}, indent=1))
    read = R.read_split_manifest(spark, path)
    assert {r.issue: r.rows for r in A.manifest_issues(read).collect()} == {
        "invalid_row": 1, "repeated_record": 1, "repeated_molecule": 1}
    W.write_rejections(read.select("record_id"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3


def test_eight_decimals(spark):
    df = spark.createDataFrame([(-0.000000015, 1), (2.5, 2), (None, 3), (1234567.123456785, 4)], "x double, n int")
    assert [r.x for r in W.eight_decimals(df).collect()] == ["-0.00000002", "2.50000000", None, "1234567.12345679"]


def test_reports_and_checksums(spark, tmp_path):
    target = str(tmp_path / "r.json")
    report = M.stage_report("clean", {"dataset": "in"}, {"dataset": "out"}, {"n": 1})
    M.write_report(spark, target, report)
    assert json.loads((tmp_path / "r.json").read_text()) == report
    with pytest.raises(FileExistsError):
        M.write_report(spark, target, report)
    with pytest.raises(ValueError):
        M.write_report(spark, str(tmp_path / "r.txt"), report)
    with pytest.raises(ValueError, match="input or output"):
        M.write_report(spark, "x.json", M.stage_report("s", {"a": "x.json"}, {}, {}))
    found = W.checksums(spark, [target]).first()
    import hashlib

    content = (tmp_path / "r.json").read_bytes()
    assert (found.sha256, found.bytes) == (hashlib.sha256(content).hexdigest(), len(content))


def test_misaligned_side_table(spark):
    left = spark.createDataFrame([("a", "k"), ("b", "k")], "record_id string, key string")
    right = spark.createDataFrame([("a", "k"), ("wrong", "k")], "record_id string, key string")
    with pytest.raises(ValueError, match="not aligned"):
        A.require_aligned(left, right, "key")
    A.require_aligned(left, left, "key")
    assert A.alignment_audit(left, left.unionByName(left)).first().repeated_record_ids == 2


def test_paired_side_table(spark):
    base = dict.fromkeys(SIDECAR.names)
    rows = [
        {**base, "record_id": "ok", "rdkit_status": "ok", "morgan_ecfp4_2048": bytearray(256), "maccs_keys_166_bits": "01" * 83},
        {**base, "record_id": "short", "rdkit_status": "ok", "morgan_ecfp4_2048": bytearray(255), "maccs_keys_166_bits": "01" * 83},
        {**base, "record_id": "bits", "rdkit_status": "ok", "morgan_ecfp4_2048": bytearray(256), "maccs_keys_166_bits": "2" * 166},
        {**base, "record_id": "bad", "rdkit_status": "invalid_smiles"},
    ]
    found = A.paired_issues(spark.createDataFrame(rows, SIDECAR)).collect()
    assert {r.record_id: r.reason for r in found} == {"short": "fingerprint_length", "bits": "bit_string", "bad": "status"}


def test_zero_variance_fails(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 3.0])], "record_id string, embedding array<double>")
    with pytest.raises(Exception, match="zero training variance"):
        A.standardized(rows, rows).collect()
