import json

from conftest import c_peak, h_peak, record
from peakloom.plans.rebuild import KEY, rebuild
from peakloom.sources import manifest


def spectrum(record_id, key, shift=1.0):
    return record(record_id, key=key, h=[h_peak(shift)], c=[c_peak(20.0)])


def test_whole_build(spark, records, tmp_path):
    train = [records([spectrum("t1", "CCO"), spectrum("t2", "CCN")]),
             records([spectrum("t3", "CCN"), spectrum("t4", "CCC"), spectrum("far", "X", 99.0)])]
    test = [records([spectrum("b1", "SIM"), spectrum("b2", "GYM"), spectrum("b3", "NEW")])]
    simulated = records([spectrum(f"s{i}", k) for i, k in enumerate(["SIM", "S1", "S2", "S3", "CCC"])])
    shift_only = records([spectrum(f"g{i}", k) for i, k in enumerate(["GYM", "S1", "G2"])])
    labels = spark.createDataFrame(
        [("e", "train_val", "CCO", "1.0", 0), ("e", "test", "SIM", "2.0", 1)],
        "endpoint string, split string, key string, label string, row_no long")
    root = str(tmp_path / "build")
    counts = rebuild(spark, train, test, simulated, shift_only, labels, root, {"rich": 1, "simulated": 2, "shift_only": 1})
    # b1 moves to training, b2 leaves with the shift-only pool, one CCN copy and the outlier go
    assert counts["cleaned/rich"] == 4 and counts["cleaned/benchmark"] == 1
    assert counts["cohorts"] == 2 and counts["pool/rich"] == 2
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    assert [r.record_id for r in read("cleaned/benchmark").collect()] == ["b3"]
    assert sorted(r.duplicate_of for r in read("removed/rich").filter("duplicate_of is not null").collect()) == ["t2"]
    keys = {s: {r[KEY] for n in ("rich", "simulated", "shift_only") for r in read(f"splits/{n}_{s}").collect()}
            for s in ("train", "validation")}
    assert not keys["train"] & keys["validation"] and keys["train"] | keys["validation"] >= {"CCN", "CCC", "S1", "S2", "S3", "GYM", "G2"}
    assert json.loads(manifest.read_text(spark, f"{root}/report.json"))["counts"] == counts
