"""Outputs that belong together appear together, wherever the writer breaks off."""

import pytest

from peakloom.operators.clean import CleaningPolicy
from peakloom.sources import manifest as M
from peakloom.sources import publish as P
from peakloom.sources import readers, writers
from conftest import h_peak, record


class Broken(Exception):
    pass


def made(records, n):
    rows = [record(f"r{i}", key=f"K{i}", h=[h_peak(1.0 + i)]) for i in range(n)]
    return records([*rows, record("empty", key="E")])


def state(spark, cleaned, removed):
    """Rows of both outputs and the counts of both manifests, as readers see them."""
    found = []
    for target in (cleaned, removed):
        lineage = P.manifest_of(spark, target)["lineage"][-1]["counts"]
        found.append((spark.read.parquet(P.resolve(spark, target)).count(), lineage["output_records"]))
    return found


@pytest.mark.parametrize("step", ["write_text", "_carry_out", "rename", "_close"])
@pytest.mark.parametrize("call", [0, 1, 2])
def test_a_break_leaves_old_or_new_but_never_both(spark, records, tmp_path, monkeypatch, step, call):
    cleaned, removed = f"{tmp_path}/cleaned", f"{tmp_path}/removed"
    policy = CleaningPolicy()
    writers.write_cleaned(made(records, 3), cleaned, removed, ["a"], policy)
    assert state(spark, cleaned, removed) == [(3, 3), (1, 3)]
    calls = []

    def counted(original):
        def run(*args, **kwargs):
            calls.append(1)
            if len(calls) == call + 1:
                raise Broken
            return original(*args, **kwargs)
        return run

    module = P if step.startswith("_") else M
    with monkeypatch.context() as patch:
        original = P.publish

        def publish(spark, moves):  # only publication breaks, not the writing before it
            patch.setattr(module, step, counted(getattr(module, step)))
            return original(spark, moves)

        patch.setattr(writers, "publish", publish)
        try:
            writers.write_cleaned(made(records, 5), cleaned, removed, ["a"], policy, overwrite=True)
        except Broken:
            pass
    seen = state(spark, cleaned, removed)
    assert seen in ([(3, 3), (1, 3)], [(5, 5), (1, 5)])
    P.recover(spark, removed)
    assert state(spark, cleaned, removed) == seen
    assert [spark.read.parquet(t).count() for t in (cleaned, removed)] == [s[0] for s in seen]
    writers.write_cleaned(made(records, 4), cleaned, removed, ["a"], policy, overwrite=True)
    assert state(spark, cleaned, removed) == [(4, 4), (1, 4)]
    assert not [f for f in map(str, tmp_path.iterdir()) if f.endswith((P.LINK_SUFFIX, P.RECORD_SUFFIX)) and "/." not in f]


def test_canonical_readers_follow_a_publication_under_way(spark, records, tmp_path, monkeypatch):
    target = f"{tmp_path}/table"
    writers.write_canonical(made(records, 2), target, "s", "c", toolkit_version="1")
    with monkeypatch.context() as patch:
        patch.setattr(M, "rename", lambda *a: (_ for _ in ()).throw(Broken()))
        with pytest.raises(Broken):
            writers.write_canonical(made(records, 7), target, "s", "c", toolkit_version="2", overwrite=True)
    assert readers.read_canonical(spark, target).count() == 8
    assert readers.read_records(spark, [target]).count() == 8
    assert P.manifest_of(spark, target)["toolkit_version"] == "2" and P.published(spark, target)
    assert P.recover(spark, target) and not P.recover(spark, target)
    assert spark.read.parquet(target).count() == 8


def test_outputs_are_not_replaced_unasked(spark, records, tmp_path):
    cleaned, removed = f"{tmp_path}/cleaned", f"{tmp_path}/removed"
    writers.write_cleaned(made(records, 1), cleaned, removed, ["a"])
    with pytest.raises(FileExistsError):
        writers.write_cleaned(made(records, 2), cleaned, removed, ["a"])
    assert spark.read.parquet(cleaned).count() == 1


def test_a_lost_row_fails_the_stage(spark, records, tmp_path, monkeypatch):
    cleaned, removed = f"{tmp_path}/cleaned", f"{tmp_path}/removed"
    counted = writers._rows

    def lossy(spark, path):  # a part file is gone before the files are counted
        if path.startswith(cleaned):
            next(p for p in (tmp_path / "cleaned.staging").iterdir() if p.name.startswith("part-")).unlink()
        return counted(spark, path)

    monkeypatch.setattr(writers, "_rows", lossy)
    with pytest.raises(RuntimeError, match="rows were computed"):
        writers.write_cleaned(made(records, 6).repartition(4), cleaned, removed, ["a"])
    assert not P.published(spark, cleaned) and not P.published(spark, removed)
    monkeypatch.undo()
    assert writers.write_cleaned(made(records, 6).repartition(4), cleaned, removed, ["a"])["output_records"] == 6


def test_empty_outputs_are_counted(spark, records, tmp_path):
    assert writers.write_canonical(records([]), f"{tmp_path}/none", "s", "c") == 0
    assert writers.write_embeddings(spark.createDataFrame([], "record_id string, embedding array<float>"), f"{tmp_path}/e", 3, {}) == 0
