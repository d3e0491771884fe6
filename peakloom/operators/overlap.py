"""Leakage between pools: matching, decontamination, transfer and audits.

Matching is exact equality of a key column. Key lists are made distinct before
they meet the large side, so the large side is the only one that can be skewed;
its join is a left semi or anti join, which adaptive execution splits at hot keys.
Where one side is far smaller, `near_keys` takes the rows of the large side that
cannot match out of it first, so that only matches and few others are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.text import connectivity_key
from peakloom.operators.prefilter import may_match
from peakloom.session import cut_lineage


def _some_key(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def first_listed(comparisons: list[DataFrame], key: str) -> DataFrame:
    """Every comparison key with the position of the first table that has it."""
    tagged = [_some_key(df, key).withColumn("first_table", F.lit(i)) for i, df in enumerate(comparisons)]
    return union_all(tagged).groupBy(key).agg(F.min("first_table").alias("first_table"))


def near_keys(tables: list[DataFrame], small: DataFrame, key: str) -> list[DataFrame]:
    """The tables' rows that may share a key with `small`, whose distinct keys are written once and turned into a bitmap."""
    listed = cut_lineage(_some_key(small, key).distinct())
    return [may_match(t.filter(F.col(key).isNotNull()), listed, [key]) for t in tables]


def decontaminate(benchmark: DataFrame, comparisons: list[DataFrame], key: str) -> DataFrame:
    """Benchmark rows whose key occurs in none of the comparison tables."""
    if not comparisons:
        raise ValueError("at least one comparison table is required")
    return benchmark.join(first_listed(comparisons, key).select(key), key, "left_anti")


def matched_keys(table: DataFrame, candidates: DataFrame, key: str, prefilter: bool = False) -> DataFrame:
    """The distinct candidate keys that occur in a large table, whose other rows `prefilter` keeps from being shuffled."""
    if prefilter:
        table = near_keys([table], candidates, key)[0]
    return _some_key(candidates, key).distinct().join(_some_key(table, key), key, "left_semi")


def _keys_with_first_match(benchmark: DataFrame, comparisons: list[DataFrame], key: str) -> DataFrame:
    """Per key: benchmark records and the first comparison table that has it.

    One aggregation over the tagged union; there is no join that a key with very
    many records could unbalance.
    """
    own = benchmark.select(key, F.lit(1).alias("_own"), F.lit(None).cast("int").alias("_table"))
    listed = [
        _some_key(df, key).withColumns({"_own": F.lit(0), "_table": F.lit(i)})
        for i, df in enumerate(comparisons)
    ]
    return union_all([own, *listed]).groupBy(key).agg(
        F.sum("_own").alias("records"), F.min("_table").alias("first_table")
    ).filter("records > 0")


def attribution(benchmark: DataFrame, comparisons: dict[str, DataFrame], key: str) -> DataFrame:
    """Removed molecules per comparison; each counts for the first that has it."""
    counts = (
        _keys_with_first_match(benchmark, list(comparisons.values()), key)
        .groupBy("first_table")
        .agg(F.count("*").alias("n"))
    )
    names = benchmark.sparkSession.createDataFrame(
        list(enumerate(comparisons)), "first_table int, comparison string"
    )
    return names.join(counts, "first_table", "left").select(
        "comparison", F.coalesce("n", F.lit(0)).alias("new_molecules")
    )


def decontamination_counts(
    benchmark: DataFrame, comparisons: list[DataFrame], key: str
) -> DataFrame:
    """Input, kept and removed records, and removed molecules, in one row."""
    hit = F.col("first_table").isNotNull()
    return _keys_with_first_match(benchmark, comparisons, key).agg(
        F.sum("records").alias("input_records"),
        F.sum(F.when(~hit, F.col("records")).otherwise(0)).alias("output_records"),
        F.sum(F.when(hit, F.col("records")).otherwise(0)).alias("removed_records"),
        F.count_if(hit).alias("removed_molecules"),
    )


def transfer(
    benchmark: DataFrame, reference: DataFrame, train: DataFrame, key: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move benchmark rows with a key in `reference` to the end of `train`.

    Returns (remaining benchmark, extended train, moved rows).
    """
    keys = _some_key(reference, key).distinct()
    moved = benchmark.join(keys, key, "left_semi")
    remaining = benchmark.join(keys, key, "left_anti")
    return remaining, train.unionByName(moved.select(*train.columns)), moved


def transfer_conflicts(moved: DataFrame, train: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Moved record IDs that already exist in the training table; must be empty."""
    return moved.select(record_id).join(train.select(record_id), record_id, "left_semi").distinct()


def merge_tables(tables: list[DataFrame], order: str = "input_order") -> DataFrame:
    """Union of compatible tables tagged with the position of their input."""
    if not tables:
        raise ValueError("nothing to merge")
    if any(t.columns != tables[0].columns for t in tables):
        raise ValueError("the inputs have different columns")
    return union_all([t.withColumn(order, F.lit(i)) for i, t in enumerate(tables)])


def held_out_overlap(test: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    return matched_keys(test, selected, key)


def identity_index(records: DataFrame, key: str, text: str, row_no: str) -> DataFrame:
    """Per key: record count, connectivity key and the text of the first row."""
    return (
        records.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count("*").alias("record_count"),
            F.min(F.struct(row_no, text)).alias("_first"),
        )
        .select(
            key,
            connectivity_key(F.col(key)).alias("connectivity"),
            F.col(f"_first.{text}").alias("representative"),
            "record_count",
        )
    )


def index_rows(records: DataFrame, key: str, text: str, row_no: str, parts: int) -> DataFrame:
    """The identity index in the form that `merge_index` keeps: with the first row's number, and a partition by key hash."""
    grouped = records.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("record_count"), F.min(F.struct(F.col(row_no).alias("row_no"), F.col(text).alias("text"))).alias("_first"))
    return _indexed(grouped, key, parts)


def _indexed(grouped: DataFrame, key: str, parts: int) -> DataFrame:
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")
    return grouped.select(
        key, connectivity_key(F.col(key)).alias("connectivity"), F.col("_first.text").alias("representative"),
        F.col("_first.row_no").alias("first_row"), "record_count", part.alias("part"))


def merged_index(index: DataFrame, batch: DataFrame, key: str, parts: int) -> DataFrame:
    """Two indexes in one: counts added up, the representative with the smaller row number kept."""
    first = F.struct(F.col("first_row").alias("row_no"), F.col("representative").alias("text"))
    both = index.select(key, "record_count", first.alias("_first")).unionAll(batch.select(key, "record_count", first.alias("_first")))
    return _indexed(both.groupBy(key).agg(F.sum("record_count").alias("record_count"), F.min("_first").alias("_first")), key, parts)


def identity_totals(records: DataFrame, key: str) -> DataFrame:
    per_key = records.groupBy(key).agg(F.count("*").alias("n"))
    known = F.col(key).isNotNull()
    return per_key.agg(
        F.sum("n").alias("records"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unkeyed_records"),
        F.count_if(known).alias("unique_molecules"),
        F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("duplicates_beyond_unique"),
    )


def overlap_audit(properties: DataFrame, index: DataFrame, release: str, key: str) -> DataFrame:
    """Exact and connectivity-level overlap of every property release with an index."""
    rows = properties.groupBy(release).agg(
        F.count("*").alias("property_rows"),
        F.count_if(F.col(key).isNull()).alias("invalid_rows"),
    )
    keys = properties.filter(F.col(key).isNotNull()).groupBy(release, key).agg(F.count("*").alias("n"))
    exact = keys.join(index.select(key, "record_count"), key, "left")
    hit = F.col("record_count").isNotNull()
    by_key = exact.groupBy(release).agg(
        F.count("*").alias("unique_molecules"),
        F.count_if(hit).alias("exact_overlap"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("matched_records"),
    )
    groups = exact.groupBy(release, connectivity_key(F.col(key)).alias("connectivity")).agg(
        F.max(hit).alias("has_exact")
    )
    known_groups = index.select("connectivity").distinct()
    by_group = (
        groups.join(known_groups, "connectivity", "left_semi")
        .groupBy(release)
        .agg(
            F.count("*").alias("connectivity_overlap"),
            F.count_if(~F.col("has_exact")).alias("connectivity_only"),
        )
    )
    zero = F.lit(0)
    unique = F.coalesce("unique_molecules", zero)
    share = F.lit(100.0) * F.col("exact_overlap") / F.col("unique_molecules")
    return (
        rows.join(by_key, release, "left")
        .join(by_group, release, "left")
        .select(
            release,
            "property_rows",
            "invalid_rows",
            unique.alias("unique_molecules"),
            (F.col("property_rows") - F.col("invalid_rows") - unique).alias("rows_beyond_unique"),
            F.coalesce("exact_overlap", zero).alias("exact_overlap"),
            F.coalesce(F.round(share, 2), F.lit(0.0)).alias("exact_overlap_percent"),
            F.coalesce("matched_records", zero).alias("matched_records"),
            F.coalesce("connectivity_overlap", zero).alias("connectivity_overlap"),
            F.coalesce("connectivity_only", zero).alias("connectivity_only"),
        )
    )


def overlap_details(properties: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Property rows with an exact match and what the index knows about them."""
    keyed = properties.withColumn("connectivity", connectivity_key(F.col(key)))
    return keyed.join(index, [key, "connectivity"], "inner")
