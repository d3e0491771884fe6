import pytest
from pyspark.sql import functions as F

from peakloom.functions import text as X
from peakloom.functions.text import normalize_multiplicity
from peakloom.operators import conform as C
from peakloom.operators.hooks import key_hook
from peakloom.schema import CANONICAL, same_shape

RICH = """key string, split string, smiles string, smiles_canonical string, nmr_frequency double, nmr_solvent string,
h_peaks array<struct<centroid:string,delta:string,range_min:string,range_max:string,category:string,n_h:string,j_values:string>>,
c_peaks array<struct<delta_ppm:string,integral:string,intensity:string,width_ppm:string>>"""


def rich(spark, h, c=None, keep=False, smiles="CC"):
    df = spark.createDataFrame([("k", "train", smiles, None, 400.0, " ", h, c)], RICH)
    return C.conform_rich(df, "lit", "lit", keep)


def test_rich_mapping(spark):
    df = rich(spark, [("6.75", None, "6.5", "7", "HEPT ", "04", "_15.5__0.25_")], [("-3.5", "0.5", "1e2", " 9 ")])
    assert same_shape(df.drop("conform_issues").schema, CANONICAL)
    r = df.first()
    peak = r.h_nmr_peaks[0]
    assert (r.record_id, r.nmr_frequency, r.nmr_solvent) == ("lit:train:k", "400.0", None)
    assert (peak.multiplicity, peak.multiplicity_raw, peak.j_values) == ("sept", "HEPT", [15.5, 0.25])
    assert (peak.shift, peak.integration, peak.range_half_span) == (6.75, 4, 0.25)
    assert r.c_nmr_peaks[0].asDict() == {"shift": -3.5, "integral": None, "intensity": None, "width": None}
    kept = rich(spark, [], [("-3.5", "0.5", "1e2", " 9 ")], keep=True).first().c_nmr_peaks[0]
    assert (kept.integral, kept.intensity, kept.width) == (0.5, 100.0, 9.0)


def test_rich_point_range_and_null_modalities(spark):
    peak = rich(spark, [(None, "-0.125", None, None, "brd", "11.0 H", "")]).first().h_nmr_peaks[0]
    assert (peak.shift, peak.multiplicity, peak.integration, peak.j_values) == (-0.125, "bd", 11, [])
    assert (peak.range_min, peak.range_max, peak.range_half_span) == (-0.125, -0.125, 0.0)
    middle = rich(spark, [(None, None, "-1.5", "4.75", " ", None, "__")]).first().h_nmr_peaks[0]
    assert (middle.shift, middle.integration, middle.j_values) == (1.625, None, [])
    assert rich(spark, None).first().h_nmr_peaks == []


RICH_CASES = [
    (("1.0", None, "1.0", None, None, None, None), "incomplete_range"),
    (("1.0", None, "2.0", "1.0", None, None, None), "invalid_range"),
    ((None, None, None, None, None, None, None), "missing_shift"),
    (("nan", None, None, None, None, None, None), "invalid_number"),
    (("1e999", None, None, None, None, None, None), "invalid_number"),
    (("1d", None, None, None, None, None, None), "invalid_number"),
    (("1.0", None, None, None, None, "2.5", None), "invalid_integration"),
    (("1.0", None, None, None, None, "-1", None), "invalid_integration"),
    (("1.0", None, None, None, None, None, "J"), "invalid_j_values"),
]


def test_rich_issues(spark):
    found = rich(spark, [peak for peak, _ in RICH_CASES]).first().conform_issues
    assert [i.code for i in found] == [code for _, code in RICH_CASES]
    assert [i.path.split("]")[0] for i in found] == [f"h_nmr_peaks[{i}" for i in range(len(RICH_CASES))]


def test_integration_texts(spark):
    cases = {"0": 0, "2.0": 2, "2H": 2, "3.0 h": 3, "": None, " ": None}
    r = rich(spark, [("1.0", None, None, None, None, text, None) for text in cases]).first()
    assert [p.integration for p in r.h_nmr_peaks] == list(cases.values()) and r.conform_issues == []


TOK = "id string, row_index long, split string, original_smiles string, smiles string, tokenized_input string"


def test_tokenised(spark):
    text = '{"13CNMR": [201.5, -7, 0.25], "1HNMR": [[8.5, 0.0, "p", "12H", [4.5, 0.5]], [-2, 0.75, null, "1H", []]]}'
    df = spark.createDataFrame([(None, 4, "test", None, "CC", text), ("7", 5, "test", "N", "CC", '{"13CNMR": null}')], TOK)
    a, b = C.conform_tokenised(df, "tok", "tok").orderBy("record_id").collect()[::-1]
    assert a.record_id == "tok:test:row-4:row-4" and b.record_id == "tok:test:7:row-5" and b.smiles == "N"
    peak = a.h_nmr_peaks[0]
    assert (peak.multiplicity, peak.integration, peak.j_values) == ("quint", 12, [4.5, 0.5])
    assert (peak.range_min, peak.range_max) == (8.5, 8.5)
    second = a.h_nmr_peaks[1]
    assert (second.shift, second.multiplicity, second.range_min, second.range_max) == (-2.0, None, -2.75, -1.25)
    assert [p.shift for p in a.c_nmr_peaks] == [201.5, -7.0, 0.25] and b.h_nmr_peaks == [] and b.c_nmr_peaks == []
    assert a.conform_issues == b.conform_issues == []


TOKENISED_CASES = [
    ("[1, 2]", "invalid_json"), (None, "invalid_json"), ('{"1HNMR": 5}', "invalid_peak_list"),
    ("{broken", "invalid_json"), ('{"1HNMR": [[1.0, 0.1]]}', "incomplete_peak"),
    ('{"1HNMR": [[1.0, -0.1, null, "1H", []]]}', "negative_half_span"),
    ('{"1HNMR": [["x", 0.1, null, "1H", []]]}', "invalid_number"),
    ('{"1HNMR": [[1.0, 0.1, null, "1H", ["y"]]]}', "invalid_j_values"),
]


def test_tokenised_issues(spark):
    df = spark.createDataFrame([(None, i, "t", None, "CC", text) for i, (text, _) in enumerate(TOKENISED_CASES)], TOK)
    for row in C.conform_tokenised(df, "t", "t").collect():
        index = int(row.record_id.rsplit("-", 1)[1])
        assert [i.code for i in row.conform_issues] == [TOKENISED_CASES[index][1]]


ATOMS = "key binary, smiles string, canonical_smiles string, shifts array<double>, atom_numbers array<int>, equivalence_classes array<long>"


def test_atoms_are_grouped_in_first_seen_order(spark):
    df = spark.createDataFrame([(
        bytearray(b"k-9"), "N", None, [5.5, 77.25, 300.0, 2.25, 3.75, 70.75, 5.0], [1, 6, 7, 1, 1, 6, 1], [30, 2, 5, 11, 11, 8, 30])], ATOMS)
    r = C.conform_atoms(df, "sim", "sim").first()
    first, second = r.h_nmr_peaks
    assert (first.shift, first.integration, first.equivalence_class, first.member_shifts) == (5.25, 2, 30, [5.5, 5.0])
    assert (second.shift, second.integration, second.equivalence_class, second.member_shifts) == (3.0, 2, 11, [2.25, 3.75])
    assert [p.shift for p in r.c_nmr_peaks] == [77.25, 70.75] and r.record_id == "sim:k-9" and r.conform_issues == []


def test_routing(spark):
    row = (bytearray(b"\xff"), None, None, [1.0], [1], [1])
    good = (bytearray(b"a"), " C ", None, [1.0], [1], [1])
    uneven = (bytearray(b"b"), "C", None, [1.0, 2.0], [1], [1])
    accepted, rejected = C.route(C.conform_atoms(spark.createDataFrame([row, good], ATOMS), "s", "s"))
    assert [r.record_id for r in accepted.collect()] == ["s:a"]
    assert [tuple(r) for r in rejected.collect()] == [("s:ff", None, "missing_structure")]
    with pytest.raises(Exception, match="same length"):
        C.route(C.conform_atoms(spark.createDataFrame([uneven], ATOMS), "s", "s"))[0].collect()


def test_routing_refuses_what_breaks_the_schema(spark):
    outside = rich(spark, [("10.0", None, "1.0", "2.0", None, None, None)])
    with pytest.raises(Exception, match="range"):
        C.route(outside)[0].collect()
    nameless = spark.createDataFrame([(None, 0, "C", [1.0], None), (None, 1, "C", [1.0], None)],
                                     "split string, row_index long, smiles string, h_shift array<double>, c_shift array<double>")
    assert [r.record_id for r in C.conform_shifts(nameless, "s", "s").collect()] == [None, None]
    with pytest.raises(Exception, match="non-empty"):
        C.route(C.conform_shifts(nameless, "s", "s"))[0].collect()


def test_key_hook_can_reject(spark):
    df = spark.createDataFrame([("t", 0, "abc", [1.0], None), ("t", 1, "bad", None, [2.0])],
                               "split string, row_index long, smiles string, h_shift array<double>, c_shift array<double>")
    hook = key_hook(lambda text: None if text == "bad" else text.upper())
    accepted, rejected = C.route(C.conform_shifts(df, "s", "s", structure=hook))
    assert accepted.select("smiles_canonical").first()[0] == "ABC"
    assert rejected.select("record_id", "source_smiles").collect() == [("s:t:1", "bad")]


def test_multiplicity(spark):
    cases = [(None, None), (" D ", "d"), ("HEPT", "sept"), ("<unk>", "<unk>"), ("weird", "<unk>"), ("", "<unk>")]
    df = spark.createDataFrame(cases, "x string, want string")
    assert df.filter(~normalize_multiplicity(F.col("x")).eqNullSafe(F.col("want"))).count() == 0


def test_routing_judges_a_row_once(spark):
    """The rules stand once in the plan of each side; filters and lists of codes do not repeat them."""
    good = ([1.0, 2.0], [1, 1], [0, 0])
    df = C.conform_atoms(spark.createDataFrame([(b"a", "C", None, *good), (b"b", " ", None, *good)], ATOMS), "s", "s")
    for side in C.route(df):
        assert side._jdf.queryExecution().optimizedPlan().toString().count("invalid_record_id") == 1
    assert [(r.record_id, r.reason) for r in C.routed(df).orderBy("record_id").collect()] == [("s:a", None), ("s:b", "missing_structure")]


REREAD_CASES = [
    ('{"1HNMR": [], "x": NaN}', ["invalid_json"]), ('{"13CNMR": [1], "x": -INF}', ["invalid_json"]),
    ('{"1HNMR": [[1, 0.5, "NaN", "1H", []]], "13CNMR": []}', []), ('{"1HNMR": [], "13CNMR": [1]', ["invalid_json"]),
    ('{"1HNMR": [], "13CNMR": {"a": 1}}', ["invalid_peak_list"]), (' {"13CNMR": []}', ["invalid_json"]), (' \n{"13CNMR": []}', []),
    ('[{"13CNMR": []}]', ["invalid_json"]), ("{}", []), ('{"13CNMR": null, "1HNMR": null}', []),
]


def test_broken_list_beside_a_read_one_is_no_json(spark):
    broken = ['{"13CNMR": [1], "1HNMR": [[1, foo]]}', '{"13CNMR": [1], "1HNMR": [+1]}', '{"13CNMR": [1], "1HNMR": [[1 2, "s", 1, []]]}']
    df = spark.createDataFrame([(None, i, "t", None, "CC", text) for i, text in enumerate(broken)], TOK)
    out = C.conform_tokenised(df, "t", "t").collect()
    assert len(out) == 3 and all("invalid_json" in [i.code for i in r.conform_issues] for r in out)


def test_tokenised_text_is_read_again_only_without_lists(spark):
    df = spark.createDataFrame([(None, i, "t", None, "CC", text) for i, (text, _) in enumerate(REREAD_CASES)], TOK)
    out = C.conform_tokenised(df, "t", "t")
    for row in out.collect():
        index = int(row.record_id.rsplit("-", 1)[1])
        assert [i.code for i in row.conform_issues] == REREAD_CASES[index][1], REREAD_CASES[index]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AND isnotnull(get_json_object(") == 2  # the second operand: most rows do not come to it
    assert plan.count("AND isnull(get_json_object(") == 1


NUMBERS = {"1": 1.0, "-2.50": -2.5, "+3.": 3.0, ".5": 0.5, "1e2": 100.0, " 4\n": 4.0, "5\u0085": 5.0, " 6": 6.0, "9" * 400: None,
           "1" * 200: float("1" * 200), "7\n8": None, "1d": None, "NaN": None, "1e999": None, "": None, "٣": None, "0x1": None}


def test_plain_numbers_read_like_others(spark):
    df = spark.createDataFrame([(t,) for t in [*NUMBERS, None]], "t string")
    got = {r.t: r.v for r in df.select("t", X.finite_double(F.col("t")).alias("v")).collect()}
    assert got == {**NUMBERS, None: None}
    texts = {"2H": False, "": False, " ": False, "x": True, "-1": True, None: False, "99999999999999999999": True}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in df.select("t", X.unreadable_integer(F.col("t")).alias("v")).collect()} == texts
