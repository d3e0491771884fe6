import pytest
from pyspark.sql import functions as F

from conftest import c_peak, h_peak, record
from peakloom.operators import dialects as D
from peakloom.operators import validate as V

NAN = float("nan")


def issues(df):
    return [(r.record_id, r.code, r.path) for r in V.issue_rows(df).orderBy("record_id", "issue_no").collect()]


def test_all_issues_with_their_places(records):
    bad = record(" ", h=[
        h_peak(1.0),
        h_peak(NAN, integration=-1, multiplicity="zz", j_values=[1.0, NAN], range_min=0.0),
        h_peak(5.0, range_min=2.0, range_max=1.0, range_half_span=-1.0),
        h_peak(5.0, range_min=1.0, range_max=2.0, range_half_span=0.6, member_shifts=[NAN]),
    ], c=[c_peak(1.0, width=NAN)])
    found = [(code, path) for _, code, path in issues(records([bad]))]
    assert found == [
        ("invalid_record_id", "record_id"),
        ("invalid_number", "h_nmr_peaks[1].shift"), ("invalid_integration", "h_nmr_peaks[1].integration"),
        ("invalid_multiplicity", "h_nmr_peaks[1].multiplicity"), ("invalid_number", "h_nmr_peaks[1].j_values[1]"),
        ("incomplete_range", "h_nmr_peaks[1]"),
        ("invalid_range", "h_nmr_peaks[2]"), ("invalid_range", "h_nmr_peaks[2].range_half_span"),
        ("inconsistent_range", "h_nmr_peaks[2].range_half_span"),
        ("shift_outside_range", "h_nmr_peaks[3].shift"), ("inconsistent_range", "h_nmr_peaks[3].range_half_span"),
        ("invalid_number", "h_nmr_peaks[3].member_shifts[0]"),
        ("invalid_number", "c_nmr_peaks[0].width"),
    ]


def test_half_span_tolerance(records):
    near = record("n", h=[h_peak(1.0, range_min=0.0, range_max=2.0, range_half_span=1.0 + 5e-7)])
    assert issues(records([near, record("null", h=None, c=None)])) == []


def test_checked_fails_with_all_messages(records):
    df = records([record("ok", h=[h_peak(1.0)]), record("bad", h=[h_peak(NAN, integration=-1)])])
    with pytest.raises(Exception, match="bad is incompatible.*shift.*integration"):
        V.checked(df).collect()
    assert V.checked(df.filter("record_id = 'ok'")).count() == 1


def test_empty_keys_are_named(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "row long, key string")
    with pytest.raises(ValueError, match="key is empty in 2 rows, first at row 2"):
        V.require_keys(df, ["key"], "row")
    V.require_keys(df.limit(1), ["key"], "row")


FULL = dict(integration=2, multiplicity="d", j_values=[7.0], range_min=0.5, range_max=1.5, range_half_span=0.5)


DIALECT_CASES = [
    ("ranged", FULL, []),
    ("ranged", {**FULL, "integration": 51}, ["invalid_integration"]),
    ("ranged", {**FULL, "range_half_span": None, "range_min": None, "range_max": None}, ["missing_shift_range"]),
    ("tokenised", {**FULL, "integration": 99}, []),
    ("tokenised", {**FULL, "range_half_span": None}, []),
    ("tokenised", {**FULL, "j_values": [1.0] * 7, "multiplicity": None}, ["missing_multiplicity", "too_many_j_values"]),
    ("expanded", {"integration": 3}, []),
    ("expanded", {"member_shifts": [1.0]}, []),
    ("expanded", {"member_shifts": [], "integration": 3}, ["empty_member_shifts"]),
    ("shift_set", {"integration": None}, ["missing_proton_expansion"]),
]


def test_dialects(records):
    df = records([record(str(i), h=[h_peak(1.0, **peak)], c=[c_peak(10.0)]) for i, (_, peak, _) in enumerate(DIALECT_CASES)])
    columns = [F.transform(D.dialect_issues(d), lambda x: x["code"]).alias(d) for d in D.DIALECTS]
    for row in df.select("record_id", *columns).collect():
        dialect, _, codes = DIALECT_CASES[int(row.record_id)]
        assert row[dialect] == codes, row.record_id


def test_native_labels_and_missing_modalities(records):
    df = records([record("r", h=[h_peak(1.0, **{**FULL, "multiplicity": None, "multiplicity_raw": "x"})], c=[])])
    native = df.select(F.transform(D.dialect_issues("ranged", native=True), lambda x: x["code"])).first()[0]
    assert native == ["missing_c_nmr"]
    size = df.select(F.size(D.encoder_issues())).first()[0]
    assert size == 0
