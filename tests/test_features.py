import math

from pyspark.sql import functions as F

from conftest import c_peak, h_peak, record
from peakloom.functions import keyed_random as R
from peakloom.functions import model_inputs as I
from peakloom.functions import peaks as P
from peakloom.functions import text as X
from peakloom.functions import vectors as V
from peakloom.operators import augment as A
from peakloom.operators import hooks
from pyspark.sql import types as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_vector_functions(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert math.isclose(one(spark, V.cosine(a, b)), 1 / math.sqrt(2))
    assert one(spark, V.is_valid_vector(F.array(F.lit(0.0), F.lit(0.0)), 2)) is False
    assert one(spark, V.is_valid_vector(F.array(F.lit(1.0), F.lit(float("nan"))), 2)) is False
    assert one(spark, V.is_valid_vector(F.lit(None).cast("array<double>"), 2)) is False
    words = F.array(F.lit(0b1011).cast("long"), F.lit(1).cast("long"))
    assert one(spark, V.tanimoto_words(words, F.array(F.lit(0b0011).cast("long"), F.lit(0).cast("long")))) == 0.5
    assert math.isclose(sum(one(spark, V.soft_bins(F.lit(3.3), 0.0, 10.0, 11, 1.0))), 1.0)
    assert one(spark, V.rbf_expansion(F.lit(5.0), 0.0, 10.0, 3, 5.0))[1] == 1.0
    assert [one(spark, V.bin_index(F.lit(v), 0.0, 0.05, 21)) for v in (-0.2, 0.0, 0.051, 1.0, 7.0)] == [0, 0, 1, 20, 20]
    assert [one(spark, V.similarity_weight(F.lit(v))) for v in (0.0, 0.5, 1.0)] == [1.0, 5.0, 20.0]
    assert one(spark, V.unpack_bits(F.unhex(F.lit("01FF")), 2)) == [1, 0, 0, 0, 0, 0, 0, 0] + [1] * 8
    assert one(spark, V.unpack_bits(F.unhex(F.lit("01")), 2)) is None
    assert one(spark, V.bits_from_text(F.lit("0110"), 4)) == [0, 1, 1, 0]
    assert one(spark, V.bits_from_text(F.lit("012"), 3)) is None


def test_text_functions(spark):
    assert one(spark, X.mean_sd_text(F.lit(0.5), F.lit(None).cast("double"), F.lit(1))) == "0.5000"
    assert one(spark, X.mean_sd_text(F.lit(0.5), F.lit(0.25), F.lit(3))) == "0.5000 ± 0.2500"
    assert one(spark, X.binary_key_text(F.unhex(F.lit("")))) == ""
    assert one(spark, X.connectivity_key(F.lit("AB-CD-E"))) == "AB"


def test_encoder_and_sequence_columns(spark, records):
    df = records([record("r", h=[
        h_peak(1.0, integration=2, multiplicity="<unk>", j_values=[], member_shifts=[0.5, 1.5]),
        h_peak(3.0, integration=3, j_values=[7.0], range_half_span=0.1)], c=[c_peak(10.0), c_peak(500.0)])])
    r = df.select(*[c.alias(n) for n, c in I.encoder_columns().items()]).first()
    assert r.h_shift[:3] == [1.0, 3.0, 0.0] and len(r.h_shift) == 60 and sum(r.h_peak_mask) == 2
    assert r.h_multiplicity[:2] == [1, 0] and r.h_j_values[1] == [7.0, 0, 0, 0, 0, 0] and r.h_j_mask[1][:2] == [True, False]
    assert r.h_availability[:3] == [[True, True, True, False], [True, False, True, True], [False] * 4]
    s = df.select(*[c.alias(n) for n, c in I.sequence_columns(9).items()]).first()
    assert s.shifts == [0.5, 1.5, 3.0, 3.0, 3.0, 10.0, 500.0, 0.0, 0.0] and s.sequence_length == 7
    assert s.types == [0] * 5 + [1] * 2 + [0] * 2 and s.counts == [1.0] * 5 + [0.0] * 4
    assert s.padding_mask == [False] * 7 + [True] * 2
    assert df.select(I.scaled_carbon(F.col("c_nmr_peaks"))).first()[0] == [10 / 220, 1.0]
    assert df.select(P.annotation_count(F.col("h_nmr_peaks")), P.missing_or_unknown_count(F.col("h_nmr_peaks"))).first() == (6, 3)


def test_ranged_and_tokenised_dialects(spark, records):
    df = records([record("r", h=[h_peak(1.5, integration=2, multiplicity="sept", multiplicity_raw="Hept", j_values=[7.2, 2.1],
                                        range_min=1.0, range_max=2.0)], c=[c_peak(18.5)])])
    h = F.col("h_nmr_peaks")
    peak = df.select(I.ranged_protons(h)).first()[0][0]
    assert (peak.category, peak.nH, peak.j_values) == ("hept", 2, "7.2_2.1")
    assert df.select(I.ranged_protons(h, native=True)).first()[0][0].category == "Hept"
    assert df.select(I.tokenised_json(h, F.col("c_nmr_peaks"))).first()[0] == (
        '{"1HNMR": [[1.5, 0.5, "sept", "2H", [7.2, 2.1]]], "13CNMR": [18.5]}')


def test_keyed_numbers_are_uniform_and_normal(spark):
    d = R.digest(1, "t", F.col("id"))
    df = spark.range(20_000).select(R.uniform(d, 0).alias("u"), R.uniform(d, 3).alias("v"), R.normal(d).alias("n"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.corr("u", "v"), F.avg("n"), F.stddev("n")).first()
    assert abs(r[0] - 0.5) < 0.01 and 0 <= r[1] < 0.001 and 0.999 < r[2] < 1 and abs(r[3]) < 0.03
    assert abs(r[4]) < 0.03 and abs(r[5] - 1) < 0.03


def test_augmentation_properties(spark, records):
    rows = [record(f"r{i}", h=[h_peak(-5.4, integration=1, multiplicity="<unk>"), h_peak(19.9, multiplicity="d", j_values=[1.0])], c=[c_peak(5.0)]) for i in range(60)]
    df = records(rows + [record("none", h=[], c=[])])
    h, rid = F.col("h_nmr_peaks"), F.col("record_id")

    def shifted(layout):
        out = layout.select("record_id", A.global_shift(h, rid, "h", -5.5, 20.0, 1.0, 0.7, 1).alias("p"))
        return {r.record_id: [p.shift for p in r.p] for r in out.collect()}

    found = shifted(df.repartition(1))
    assert found == shifted(df.repartition(6)) and found["none"] == []
    moved = [v for k, v in found.items() if k != "none" and v != [-5.4, 19.9]]
    assert 20 < len(moved) < 60
    assert all(-5.5 <= a and b <= 20.0 and math.isclose(b - a, 25.3) for a, b in moved)
    masked = df.select("record_id", A.masked_peak(h, rid, "h", 1).alias("m")).collect()
    assert {r.m for r in masked if r.record_id != "none"} == {0, 1} and [r.m for r in masked if r.record_id == "none"] == [None]
    dropped = df.select(A.masked_annotations(h, rid, 1.0, 1).alias("p")).first().p
    assert dropped[0].integration is None and dropped[0].multiplicity == "<unk>" and dropped[1].multiplicity is None
    sides = [r[0] for r in df.select(A.dropped_modality(h, F.col("c_nmr_peaks"), rid, 1.0, 1)).collect()]
    assert set(sides) == {"h", "c", None} and sides.count(None) == 1


def test_status_hook_never_drops_a_row(spark):
    def compute(text):
        if text == "bad":
            return None
        if text == "boom":
            raise ValueError("no")
        return {"n": len(text)}

    rows = spark.createDataFrame([("1", "CC"), ("2", "bad"), ("3", None), ("4", " "), ("5", "boom")], "record_id string, smiles string")
    found = hooks.with_status(rows, "smiles", compute, T.StructType([T.StructField("n", T.LongType())])).collect()
    assert {r.record_id: (r.status, r.n) for r in found} == {
        "1": ("ok", 2), "2": ("invalid_smiles", None), "3": ("missing_smiles", None), "4": ("missing_smiles", None), "5": ("calculation_error", None)}


def test_embed_policy(spark, records):
    import pytest

    df = records([record("a", h=[h_peak(1.0)]), record("b", h=[])])
    issues = F.when(F.size("h_nmr_peaks") == 0, F.array(F.lit("missing"))).otherwise(F.array().cast("array<string>"))
    encode = lambda batch: [[1.0, 2.0]] * len(batch)
    done, refused = hooks.embed(df, issues, encode, ["smiles"])
    assert [(r.record_id, r.embedding) for r in done.collect()] == [("a", [1.0, 2.0])]
    assert [r.record_id for r in refused.collect()] == ["b"]
    with pytest.raises(Exception, match="incompatible record b"):
        hooks.embed(df, issues, encode, ["smiles"], on_incompatible="error")[0].collect()
