"""Deterministic, molecule-safe splits, shards, mixtures and shuffles.

Every choice is a function of seed and key, so it does not depend on row order,
partitioning or retries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.functions import keyed_random as R
from peakloom.functions.text import seeded_score
from peakloom.operators.overlap import union_all
from peakloom.operators.ranking import position_by_score, totals_before


def lowest_records(records: DataFrame, key: str, n_records: int, seed: int) -> DataFrame:
    """Keys of the `n_records` lowest-scored records.

    Repeated keys use up as many slots as they have records; of equal scores the
    larger key comes first. Records are counted per key before ranking.
    """
    per_key = (
        records.groupBy(key)
        .agg(F.count("*").alias("_records"))
        .withColumn("_score", seeded_score(F.col(key), seed))
        .withColumn("_bucket", F.substring("_score", 1, 3))
    )
    ranked = totals_before(
        per_key, "_bucket", [F.col("_score"), F.col(key).desc()], {"_n": F.col("_records")},
        below={"_n": F.lit(n_records)},
    )
    return ranked.select(key)


def shared_holdout(
    sources: dict[str, DataFrame], quotas: dict[str, int], key: str, seed: int
) -> DataFrame:
    """Keys held out of all sources: the union of each source's selection."""
    picks = [lowest_records(df, key, quotas[name], seed) for name, df in sources.items()]
    return union_all(picks).distinct()


def apply_holdout(rows: DataFrame, held_out: DataFrame, key: str,
                  names: tuple[str, str] = ("train", "validation")) -> DataFrame:
    """Add `split`; works alike for records and their side table."""
    marked = rows.join(held_out.select(key, F.lit(True).alias("_held")), key, "left")
    split = F.when(F.col("_held"), names[1]).otherwise(names[0])
    return marked.withColumn("split", split).drop("_held")


def representatives(rows: DataFrame, key: str, *carried: str) -> DataFrame:
    """The smallest record ID of each key, with some of its columns."""
    first = F.min(F.struct("record_id", *carried)).alias("_first")
    return rows.groupBy(key).agg(first).select(key, "_first.*")


def first_keys(keys: DataFrame, key: str, sizes: dict[str, int], seed: int) -> DataFrame:
    """Take the first keys in score order, then the next ones, and so on."""
    ranked = position_by_score(
        keys, seeded_score(F.col(key), seed), [F.col(key)], at_most=F.lit(sum(sizes.values()))
    )
    wanted, split = 0, None
    for name, size in sizes.items():
        wanted += size
        here = F.col("position") <= wanted
        split = F.when(here, name) if split is None else split.when(here, name)
    short = F.when(
        F.col("group_size") < wanted,
        F.raise_error(F.concat(F.lit("too few eligible keys: "), F.col("group_size").cast("string"))).cast("string"),
    )
    return (
        ranked.withColumn("split", F.coalesce(short, split))
        .filter(F.col("split").isNotNull())
        .drop("group_size")
    )


def source_strata(records: DataFrame, key: str, source: str = "source") -> DataFrame:
    """Per molecule: its record count and its source mix as one text.

    The mix lists each source once with a count, so it is as short as the list
    of sources however many records the molecule has.
    """
    per_source = records.groupBy(key, source).agg(F.count("*").alias("n"))
    mix = F.sort_array(F.collect_list(F.struct(F.col(source).alias("s"), "n")))
    return per_source.groupBy(key).agg(
        F.sum("n").alias("records"),
        F.array_join(
            F.transform(mix, lambda x: F.concat(x["s"], F.lit("="), x["n"].cast("string"))), ";"
        ).alias("stratum"),
    )


def stratified_quota(
    molecules: DataFrame, key: str, sizes: dict[str, int], seed: int, total_records: int | None = None
) -> DataFrame:
    """Proportional quotas per stratum, in score order.

    Each quota is molecules of the stratum times wanted size over all records,
    rounded half to even. Give the number of records where it is known; else it
    is summed from the molecules in one more pass.
    """
    total = molecules.agg(F.sum("records")).scalar() if total_records is None else F.lit(total_records)
    ranked = position_by_score(
        molecules, seeded_score(F.col(key), seed), [F.col(key)], by=("stratum",)
    )
    n = F.col("group_size").cast("double")
    split, upper = None, F.lit(0).cast("bigint")
    for name, size in sizes.items():
        upper = upper + F.bround(n * F.lit(float(size)) / total, 0).cast("bigint")
        here = F.col("position") <= upper
        split = F.when(here, name) if split is None else split.when(here, name)
    return ranked.withColumn("split", split).filter("split is not null").drop("position", "group_size")


def grouped_holdout(rows: DataFrame, key: str, fraction: float, seed: int, label: str | None = None) -> DataFrame:
    """Hold out whole keys; with a label, keep the share alike in every label group."""
    by = () if label is None else ("_class",)
    keys = rows.groupBy(key).agg(
        *([F.concat_ws("-", F.min(label).cast("string"), F.max(label).cast("string")).alias("_class")] if by else [F.count("*").alias("_n")])
    )
    ranked = position_by_score(keys, seeded_score(F.col(key).cast("string"), seed), [F.col(key)], by=by)
    n = F.col("group_size")
    held = F.greatest(F.bround(n.cast("double") * F.lit(fraction), 0).cast("bigint"), F.lit(1))
    return ranked.select(
        key, F.when(F.col("position") <= held, "validation").otherwise("train").alias("split")
    )


def fold_number(key: Column, folds: int, seed: int) -> Column:
    """Fold of a key; all rows of the key share it."""
    digits = F.substring(seeded_score(key.cast("string"), seed), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def shard_number(block: Column, world_size: int, workers: int) -> dict[str, Column]:
    """Rank and worker that read a block, interleaved worker by worker."""
    shard = F.pmod(block, F.lit(world_size * workers)).cast("int")
    return {"rank": F.pmod(shard, F.lit(world_size)), "worker": F.floor(shard / world_size).cast("int")}


def starved_shards(blocks: DataFrame, block: str, world_size: int, workers: int) -> DataFrame:
    """Shards that would read nothing; a non-empty result means too few blocks."""
    used = blocks.select(
        F.pmod(F.col(block), F.lit(world_size * workers)).cast("int").alias("shard")
    ).distinct()
    every = blocks.sparkSession.range(world_size * workers).select(F.col("id").cast("int").alias("shard"))
    return every.join(used, "shard", "left_anti")


def mix_sources(records: DataFrame, weights: dict[str, float], size: int, seed: int, source: str = "source") -> DataFrame:
    """A mixture of `size` rows with a weighted quota per source.

    Quotas add up to `size`: shares are rounded down, and the largest
    remainders get one more (the first listed among equals). Sources smaller
    than their quota are cycled; the last cycle is cut by a seeded order.
    `copy_no` tells the cycles apart. A source with a quota and no rows fails
    the job.
    """
    weight_sum = sum(weights.values())
    shares = {name: size * w / weight_sum for name, w in weights.items()}
    whole = {name: math.floor(s + 1e-9) for name, s in shares.items()}
    by_remainder = sorted(shares, key=lambda name: whole[name] - shares[name])
    more = set(by_remainder[: size - sum(whole.values())])
    quotas = [(name, n + (name in more)) for name, n in whole.items()]
    quota = records.sparkSession.createDataFrame(quotas, f"{source} string, _quota long")
    counts = records.groupBy(source).agg(F.count("*").alias("_n"))
    absent = F.raise_error(F.concat(F.lit("no rows of source "), F.col(source))).cast("bigint")
    sizes = quota.join(counts, source, "left").filter("_quota > 0").select(
        source, "_quota", F.coalesce("_n", absent).alias("_n")
    )
    copies = F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("_quota") / F.col("_n")))
    repeated = (
        records.join(F.broadcast(sizes), source)  # one row per listed source
        .withColumn("copy_no", F.explode(copies))
    )
    full = F.floor(F.col("_quota") / F.col("_n"))
    whole_cycles = repeated.filter(F.col("copy_no") <= full)
    order = R.digest(seed, "mix", F.col(source), F.col("record_id"))
    last_cycle = position_by_score(
        repeated.filter(F.col("copy_no") > full), order, [F.col("record_id")], by=(source,),
        at_most=F.col("_quota") - full * F.col("_n"),
    )
    columns = [*records.columns, "copy_no"]
    return whole_cycles.select(*columns).unionByName(last_cycle.select(*columns))


def shuffled(records: DataFrame, seed: int, record_id: str = "record_id") -> DataFrame:
    """A global, reproducible random order (a range-partitioned sort)."""
    return records.orderBy(R.digest(seed, "shuffle", F.col(record_id)), record_id)
