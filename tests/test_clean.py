import random

import pytest
from pyspark.sql import functions as F

from conftest import c_peak, h_peak, record
from peakloom.operators import clean as C
from peakloom.session import scratch_path
from peakloom.sources import manifest, writers

NAN, INF = float("nan"), float("inf")
H, CARBON = [h_peak(1.0)], [c_peak(20.0)]


def removed(df):
    return {r.record_id: (r.removal_reason, r.duplicate_of) for r in C.removals(df).collect()}


REASONS = [
    (record("x", h=[], c=[]), "no_nmr_peaks"),
    (record("x", h=None, c=None), "no_nmr_peaks"),
    (record("x", h=[h_peak(NAN)]), "non_finite_h_shift"),
    (record("x", h=[h_peak(INF)]), "non_finite_h_shift"),
    (record("x", h=[h_peak(20.01)]), "h_shift_out_of_range"),
    (record("x", c=[c_peak(-INF)]), "non_finite_c_shift"),
    (record("x", c=[c_peak(-50.5)]), "c_shift_out_of_range"),
    (record("x", h=[h_peak(1.0)] * 61), "too_many_h_peaks"),
    (record("x", c=[c_peak(1.0)] * 61), "too_many_c_peaks"),
    (record("x", h=[h_peak(1.0, j_values=[1.0] * 7)]), "too_many_j_values"),
    (record("x", h=[h_peak(1.0, j_values=[-0.5])]), "invalid_j_value"),
    (record("x", h=[h_peak(1.0, j_values=[NAN])]), "invalid_j_value"),
    (record("x", h=[h_peak(1.0, integration=0)]), "non_positive_h_integration"),
    (record("x", key="C.C", h=H), "multifragment_smiles"),
    (record("x", key="C.C", h=[h_peak(99.0)], c=[c_peak(NAN)]),
     "h_shift_out_of_range;non_finite_c_shift;multifragment_smiles"),
]


def test_each_reason(records):
    rows = [{**row, "record_id": f"x{i}"} for i, (row, _) in enumerate(REASONS)]
    assert removed(records(rows)) == {f"x{i}": (reason, None) for i, (_, reason) in enumerate(REASONS)}


LEGAL = [
    record("x", h=H), record("x", c=CARBON), record("x", h=[h_peak(-5.0), h_peak(20.0)]),
    record("x", h=[h_peak(1.0, j_values=[0.0] * 6, integration=None)]), record("x", h=None, c=CARBON),
    record("x", key=None, h=H), record("x", h=[h_peak(1.0)] * 60, c=[c_peak(300.0), c_peak(-50.0)]),
]


def test_legal_records_stay(records):
    rows = [{**row, "record_id": f"x{i}", "smiles_canonical": row["smiles_canonical"] and f"K{i}"} for i, row in enumerate(LEGAL)]
    assert removed(records(rows)) == {}


def test_duplicates_keep_the_best_annotated(records):
    rows = [
        record("poor", h=[h_peak(1.0), h_peak(2.0)]),
        record("best", h=[h_peak(2.0, integration=1, j_values=[]), h_peak(1.0)]),
        record("unknown", key="N", h=[h_peak(1.0, multiplicity="<unk>")]),
        record("zknown", key="N", h=[h_peak(1.0, multiplicity="d")]),
        record("b", key="O", h=H), record("a", key="O", h=H),
        record("null-list", key="P", h=None, c=CARBON), record("empty-list", key="P", h=[], c=CARBON),
        record("no-key-1", key=None, h=H), record("no-key-2", key="", h=H),
        record("one", key="Q", h=[h_peak(1.0)]), record("two", key="Q", h=[h_peak(1.0), h_peak(1.0)]),
    ]
    found = removed(records(rows))
    assert found == {
        "poor": (C.DUPLICATE_REASON, "best"),
        "unknown": (C.DUPLICATE_REASON, "zknown"),
        "b": (C.DUPLICATE_REASON, "a"),
        "null-list": (C.DUPLICATE_REASON, "empty-list"),
    }


def test_hot_group_and_partitioning(records):
    """A third of all rows are copies of one record; any layout gives the same result."""
    rnd = random.Random(3)
    rows = [record(f"hot-{i:03d}", h=[h_peak(1.5, integration=1 if i == 77 else None)]) for i in range(120)]
    rows += [record(f"r-{i:03d}", key=f"K{rnd.randrange(40)}", h=[h_peak(float(rnd.randrange(3)))]) for i in range(240)]
    df = records(rows)
    expected = {}
    groups = {}
    for r in rows:
        signature = (r["smiles_canonical"], tuple(p["shift"] for p in r["h_nmr_peaks"]))
        groups.setdefault(signature, []).append((-sum(p["integration"] is not None for p in r["h_nmr_peaks"]), r["record_id"]))
    for members in groups.values():
        members.sort()
        expected |= {m[1]: members[0][1] for m in members[1:]}
    for layout in (df.repartition(1), df.repartition(8, F.rand(1)), df.orderBy(F.desc("record_id"))):
        assert {k: v[1] for k, v in removed(layout).items()} == expected
    assert C.clean(df).count() == len(rows) - len(expected)


def test_reason_counts_and_reconciliation(records):
    df = records([record("a", key="C.C", h=[h_peak(99.0)]), record("b", key="C.C", h=H), record("c", h=H), record("d", h=H)])
    taken = C.removals(df)
    assert {r.reason: r.records for r in C.reason_counts(taken).collect()} == {
        "h_shift_out_of_range": 1, "multifragment_smiles": 2, C.DUPLICATE_REASON: 1}
    assert C.reconciliation(df, taken).first().asDict() == {
        "filtered_records": 2, "duplicate_records": 1, "input_records": 4, "output_records": 1}


def test_cleaning_sink_publishes_both_tables(spark, records):
    df = records([record("a", h=H), record("b", h=H), record("c", h=[])])
    kept, gone = scratch_path(spark, "kept"), scratch_path(spark, "gone")
    counts = writers.write_cleaned(df, kept, gone, ["in"])
    assert counts["output_records"] == 1 and counts["removed_records"] == 2
    assert [r.record_id for r in spark.read.parquet(kept).collect()] == ["a"]
    assert manifest.read_manifest(spark, gone)["lineage"][0]["counts"]["input_records"] == 3
    with pytest.raises(FileExistsError):
        writers.write_cleaned(df, kept, gone, ["in"])
