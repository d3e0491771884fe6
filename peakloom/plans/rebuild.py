"""The whole dataset build as one driver function over published tables.

Every stage reads what the stage before published and publishes its own output
with a manifest, so a failed run continues from the last good table. Stages:
merge, transfer to training, decontaminate, clean, label cohorts, held-out split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators import cohort as C
from peakloom.operators import overlap as O
from peakloom.operators import split as S
from peakloom.operators.clean import CleaningPolicy
from peakloom.operators.validate import require_keys
from peakloom.schema import CANONICAL
from peakloom.sources import manifest as M
from peakloom.sources import writers as W

KEY = "smiles_canonical"


def _publish(df: DataFrame, target: str, step: str) -> DataFrame:
    W.write_canonical(df.select(*CANONICAL.names), target, step, "rebuild", overwrite=True)
    return df.sparkSession.read.parquet(target)


def rebuild(
    spark: SparkSession,
    train: list[DataFrame],
    test: list[DataFrame],
    simulated: DataFrame,
    shift_only: DataFrame,
    labels: DataFrame,
    root: str,
    quotas: dict[str, int],
    seed: int = 42,
    policy: CleaningPolicy = CleaningPolicy(),
) -> dict[str, int]:
    """Build all tables below `root`; returns the record count of each.

    `train` and `test` are the released parts of the rich sources, `labels` has
    endpoint, split, key, label and row_no, and `quotas` names the held-out
    records of the sources rich, simulated and shift_only.
    """
    root = root.rstrip("/")
    merged_train = O.union_all(train)
    merged_test = O.union_all(test)
    for name, df in (("train", merged_train), ("test", merged_test)):
        require_keys(df.withColumn("_row", F.lit(0)), ["record_id", KEY], "_row")
    remaining, extended, moved = O.transfer(merged_test, simulated, merged_train, KEY)
    if O.transfer_conflicts(moved, merged_train).limit(1).count():
        raise ValueError("a moved record already exists in the training table")
    rich = _publish(extended, f"{root}/merged/rich", "merge")
    bench = _publish(
        O.decontaminate(remaining, [simulated, shift_only], KEY), f"{root}/merged/benchmark", "decontaminate"
    )
    counts, cleaned = {}, {}
    for name, df in (("rich", rich), ("benchmark", bench), ("simulated", simulated), ("shift_only", shift_only)):
        target = f"{root}/cleaned/{name}"
        result = W.write_cleaned(df, target, f"{root}/removed/{name}", [name], policy, overwrite=True)
        cleaned[name] = spark.read.parquet(target)
        counts[f"cleaned/{name}"] = result["output_records"]
    keyed = cleaned["rich"].withColumn("key", F.col(KEY))
    expanded = C.expand(C.consolidate(C.drop_cross_split(labels)), keyed)
    counts["cohorts"] = W.write_cohorts(
        expanded, cleaned["rich"], f"{root}/cohorts/labels", f"{root}/cohorts/records", overwrite=True
    )
    pool = _publish(C.training_pool(keyed, labels).drop("key"), f"{root}/pool/rich", "pool")
    counts["pool/rich"] = M.read_manifest(spark, f"{root}/pool/rich")["rows"]
    sources = {"rich": pool, "simulated": cleaned["simulated"], "shift_only": cleaned["shift_only"]}
    held = S.shared_holdout(sources, quotas, KEY, seed)
    held.write.mode("overwrite").parquet(f"{root}/splits/held_out_keys")
    held = spark.read.parquet(f"{root}/splits/held_out_keys")
    for name, df in sources.items():
        for split in ("train", "validation"):
            part = S.apply_holdout(df, held, KEY).filter(F.col("split") == split)
            _publish(part, f"{root}/splits/{name}_{split}", "split")
            counts[f"splits/{name}_{split}"] = M.read_manifest(spark, f"{root}/splits/{name}_{split}")["rows"]
    M.write_report(spark, f"{root}/report.json", M.stage_report(
        "rebuild", {"train": len(train), "test": len(test)}, {"root": root}, counts), overwrite=True)
    return counts
