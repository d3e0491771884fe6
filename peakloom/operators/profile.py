"""Inventories, summaries and reconciliation of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions import peaks as P
from peakloom.functions.binding import exploded
from peakloom.operators.overlap import union_all
from peakloom.operators.quantiles import exact_quantiles
from peakloom.schema import C_RAW_AUDIT_RANGE, H_CLEAN_RANGE, MAX_PEAKS

MISSING_LABEL = "<missing>"


def record_statistics(records: DataFrame) -> DataFrame:
    return records.withColumns(
        P.statistics(F.col("atoms"), F.col("h_nmr_peaks"), F.col("c_nmr_peaks"))
    )


def _modality_counts() -> list[Column]:
    h, c = F.col("n_h_peaks") > 0, F.col("n_c_peaks") > 0
    return [
        F.count_if(h).alias("records_with_h"),
        F.count_if(c).alias("records_with_c"),
        F.count_if(h & c).alias("records_with_h_and_c"),
    ]


def distinct_values(column: str) -> Column:
    """Distinct values of a column, where null counts as one more value."""
    return F.count_distinct(column) + F.max(F.col(column).isNull().cast("int"))


def inventory(records: DataFrame, by: str = "source", key: str = "smiles_canonical") -> DataFrame:
    """Counts per source plus a grand total row `ALL`, with exact distinct keys.

    Rows are first reduced to one per (source, key); the total row's distinct
    count is taken over keys, not summed over sources.
    """
    per_key = record_statistics(records).groupBy(by, key).agg(
        F.count("*").alias("records"), *_modality_counts()
    )
    counted = per_key.rollup(by).agg(
        F.grouping(by).alias("_total"),
        F.sum("records").alias("records"),
        distinct_values(key).alias("unique_keys"),
        *[F.sum(c).alias(c) for c in ("records_with_h", "records_with_c", "records_with_h_and_c")],
    )
    return counted.withColumn(by, F.when(F.col("_total") == 1, "ALL").otherwise(F.col(by))).drop("_total")


def approximate_inventory(records: DataFrame, by: str = "source", key: str = "smiles_canonical") -> DataFrame:
    return record_statistics(records).groupBy(by).agg(
        F.count("*").alias("records"),
        F.approx_count_distinct(key, 0.02).alias("approx_unique_keys"),
        *_modality_counts(),
    )


def grouped_inventory(records: DataFrame, by: list[str], key: str = "smiles_canonical") -> DataFrame:
    return record_statistics(records).groupBy(*by).agg(
        F.count("*").alias("records"), distinct_values(key).alias("unique_keys"), *_modality_counts()
    )


def summary_columns(column: str, prefix: str | None = None, suffix: str = "") -> list[Column]:
    """mean, sample deviation, min and max of a column."""
    prefix = column if prefix is None else prefix
    return [
        F.avg(column).alias(f"{prefix}_mean{suffix}"),
        F.stddev_samp(column).alias(f"{prefix}_std{suffix}"),
        F.min(column).alias(f"{prefix}_min{suffix}"),
        F.max(column).alias(f"{prefix}_max{suffix}"),
    ]


def numeric_summary(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[e for c in columns for e in summary_columns(c)])


def prevalence(df: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags])


def proton_rows(records: DataFrame, by: str) -> DataFrame:
    return exploded(records, by, items="h_nmr_peaks").select(by, "item.*")


def carbon_rows(records: DataFrame, by: str) -> DataFrame:
    return exploded(records, by, items="c_nmr_peaks").select(by, "item.*")


def j_rows(records: DataFrame, by: str) -> DataFrame:
    flat = F.flatten(F.filter(F.transform("h_nmr_peaks", lambda p: p["j_values"]), lambda j: j.isNotNull()))
    return exploded(records, by, items=flat, name="j_hz")


def peak_summary(records: DataFrame, by: str = "source", shift_only: bool = False) -> DataFrame:
    """Record, proton, carbon and J statistics per group.

    One scan of records: each record is exploded once into typed measurements,
    and the groups are joined only after they are reduced to a row each.
    """
    stats = record_statistics(records)
    columns = ["n_h_peaks", "n_c_peaks", "h_peaks_per_atom", "c_peaks_per_atom"]
    per_record = stats.groupBy(by).agg(
        F.count("*").alias("records"), *[e for c in columns for e in summary_columns(c)]
    )
    measurements = [("h", F.transform("h_nmr_peaks", lambda p: p["shift"])),
                    ("c", F.transform("c_nmr_peaks", lambda p: p["shift"]))]
    if not shift_only:
        j = F.flatten(F.filter(F.transform("h_nmr_peaks", lambda p: p["j_values"]), lambda x: x.isNotNull()))
        measurements.append(("j", j))
    def tag(kind, values):
        tagged = F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
        return F.coalesce(tagged, F.array().cast("array<struct<kind:string,value:double>>"))

    tagged = F.concat(*[tag(kind, values) for kind, values in measurements])
    value = {k: F.when(F.col("m.kind") == k, F.col("m.value")) for k in ("h", "c", "j")}
    aggregates = []
    for kind, total, name, unit in (
        ("h", "h_total_peaks", "h_shift", "_ppm"), ("c", "c_total_peaks", "c_shift", "_ppm"),
        ("j", "j_value_count", "j", "_hz"),
    ):
        v = value[kind]
        n = F.count(v)
        if kind == "j" and shift_only:
            v = F.lit(None).cast("double")
            n = F.max(F.lit(None).cast("bigint"))
        aggregates += [
            (F.nullif(n, F.lit(0)) if not (kind == "j" and shift_only) else n).alias(total),
            F.avg(v).alias(f"{name}_mean{unit}"), F.stddev_samp(v).alias(f"{name}_std{unit}"),
            F.min(v).alias(f"{name}_min{unit}"), F.max(v).alias(f"{name}_max{unit}"),
        ]
    per_peak = exploded(records, by, items=tagged, name="m").groupBy(by).agg(*aggregates)
    return per_record.join(per_peak, by, "left")


def annotation_completeness(records: DataFrame, by: str = "source") -> DataFrame:
    h = proton_rows(records, by)
    nulls = ["integration", "multiplicity", "range_min", "range_max", "range_half_span", "j_values"]
    return h.groupBy(by).agg(
        F.count("*").alias("h_total_peaks"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in nulls],
        F.count_if(F.col("integration") == 0).alias("integration_zero"),
        F.count_if(F.size("j_values") == 0).alias("j_values_empty"),
    )


def label_distribution(rows: DataFrame, by: str, label: str) -> DataFrame:
    """Count and share of each label within its group; null is `<missing>`.

    The window runs over one pre-aggregated row per group and label.
    """
    counts = (
        rows.select(by, F.coalesce(label, F.lit(MISSING_LABEL)).alias(label))
        .groupBy(by, label)
        .agg(F.count("*").alias("n_peaks"))
    )
    share = F.col("n_peaks").cast("double") / F.sum("n_peaks").over(Window.partitionBy(by))
    return counts.withColumn("fraction", share)


def top_labels(distribution: DataFrame, label: str, k: int) -> list[str]:
    """The k most frequent labels over all groups (ties: label ascending)."""
    rows = (
        distribution.groupBy(label)
        .agg(F.sum("n_peaks").alias("n"))
        .orderBy(F.desc("n"), label)
        .limit(k)
        .collect()
    )
    return [r[label] for r in rows]


def pivot_top_labels(distribution: DataFrame, groups: DataFrame, by: str, label: str, top: list[str]) -> DataFrame:
    """Shares of the top labels per group in columns, the rest summed as `other`."""
    named = F.when(F.col(label).isin(*top), F.col(label)).otherwise("other")
    labelled = distribution.withColumn("_label", named)
    wide = labelled.groupBy(by).pivot("_label", [*top, "other"]).agg(F.sum("fraction"))
    return groups.select(by).distinct().join(wide, by, "left").na.fill(0.0)


PARTS = 32


def sample_per_group(df: DataFrame, by: str, n: int, order: list[str]) -> DataFrame:
    """The first n rows of each group in input order.

    Each group is first cut to n rows in PARTS parts that are sorted apart, so
    the last sort sees at most PARTS * n rows of a group, whatever its size.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(PARTS))
    first = Window.partitionBy(by, "_part").orderBy(*order)
    last = Window.partitionBy(by).orderBy(*order)
    kept = df.withColumn("_part", part).withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n)
    return kept.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= n).drop("_rn", "_part")


def first_rows(df: DataFrame, columns: list[str], n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n).select(*columns)


def plot_ranges(sample: DataFrame, by: str, value: str, whiskers: float = 2.5) -> DataFrame:
    """Values near the joint quartiles, counted per group.

    The range reaches `whiskers` interquartile ranges beyond the quartiles,
    which are exact for tables of any size.
    """
    quartiles = exact_quantiles(sample, value, [0.25, 0.75])
    low, high = F.col("quantiles")[0], F.col("quantiles")[1]
    reach = F.lit(float(whiskers)) * (high - low)
    bounds = quartiles.select(F.struct((low - reach).alias("lower"), (high + reach).alias("upper")))
    bounded = sample.withColumn("_q", bounds.scalar())
    inside = F.col(value).between(F.col("_q.lower"), F.col("_q.upper"))
    return bounded.groupBy(by).agg(
        F.count(value).alias("values"),
        F.count_if(inside).alias("values_in_range"),
        F.min(F.when(inside, F.col(value))).alias("shown_min"),
        F.max(F.when(inside, F.col(value))).alias("shown_max"),
        F.max("_q.lower").alias("lower"),
        F.max("_q.upper").alias("upper"),
    )


def _sum_over(peaks: str, test) -> Column:
    n = F.size(F.filter(peaks, lambda p: F.coalesce(test(p), F.lit(False))))
    return F.coalesce(F.sum(n), F.lit(0))


def table_profile(records: DataFrame) -> DataFrame:
    """One row with record, modality, annotation and shift-range totals."""
    h, c = F.col("h_nmr_peaks"), F.col("c_nmr_peaks")

    def modality(name, peaks):
        shifts = F.transform(peaks, lambda p: p["shift"])
        return [
            F.count_if(peaks.isNull()).alias(f"{name}_null_records"),
            F.count_if(F.size(peaks) == 0).alias(f"{name}_empty_records"),
            F.coalesce(F.sum(F.size(peaks)), F.lit(0)).alias(f"{name}_total_peaks"),
            F.coalesce(F.max(F.size(peaks)), F.lit(0)).alias(f"{name}_max_peaks"),
            F.min(F.array_min(shifts)).alias(f"{name}_shift_min"),
            F.max(F.array_max(shifts)).alias(f"{name}_shift_max"),
        ]

    return records.agg(
        F.count("*").alias("rows"),
        *modality("h", h),
        *modality("c", c),
        F.count_if((F.size(h) > 0) & (F.size(c) > 0)).alias("both_usable"),
        _sum_over("h_nmr_peaks", lambda p: p["integration"].isNull()).alias("integration_null"),
        _sum_over("h_nmr_peaks", lambda p: p["integration"] == 0).alias("integration_zero"),
        _sum_over("h_nmr_peaks", lambda p: p["j_values"].isNull()).alias("j_null"),
        _sum_over("h_nmr_peaks", lambda p: F.size(p["j_values"]) == 0).alias("j_empty"),
        _sum_over("h_nmr_peaks", lambda p: F.size(p["j_values"]) > 0).alias("j_nonempty"),
    )


def duplicate_id_count(records: DataFrame, record_id: str = "record_id") -> DataFrame:
    per_id = records.groupBy(record_id).agg(F.count("*").alias("n"))
    return per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_record_ids"))


def value_counts(records: DataFrame) -> DataFrame:
    """Counts of every source and every multiplicity label."""
    by_source = records.groupBy(F.col("source").alias("value")).agg(F.count("*").alias("n"))
    labels = exploded(records, items="h_nmr_peaks").select(F.col("item.multiplicity").alias("value"))
    by_label = labels.groupBy("value").agg(F.count("*").alias("n"))
    return by_source.select(F.lit("source").alias("field"), "value", "n").unionByName(
        by_label.select(F.lit("multiplicity").alias("field"), "value", "n")
    )


# The totals compared between a source and its canonical table.
TOTALS = (
    "rows", "h_no_peak_records", "c_no_peak_records", "both_modality_usable_records",
    "h_total_peaks", "c_total_peaks", "h_max_peaks", "c_max_peaks",
    "zero_integration_peaks", "j_null_peaks", "j_empty_peaks", "j_nonempty_peaks",
)
MAXIMA = ("h_max_peaks", "c_max_peaks")


def raw_totals(landing: DataFrame, by: list[str], *, integration: str, j_is_missing, j_is_empty,
               h_shift=None, c_shift=None) -> DataFrame:
    """Totals and observations of a landing table per split.

    `landing` has `h_peaks` and `c_peaks` arrays. `j_is_missing` and `j_is_empty`
    test one raw proton peak; shifts are tested only where a reader is given.
    """
    h, c = F.col("h_peaks"), F.col("c_peaks")
    n_h, n_c = P.peak_count(h), P.peak_count(c)

    def hits(peaks, test):
        return F.coalesce(F.size(F.filter(peaks, lambda p: F.coalesce(test(p), F.lit(False)))), F.lit(0))

    zero = hits(h, lambda p: p[integration] == 0)
    missing_j = hits(h, j_is_missing)
    empty_j = hits(h, j_is_empty)
    no_test = F.lit(0)

    def outside(reader, low, high):
        return lambda p: ~reader(p).between(low, high)

    h_out = hits(h, outside(h_shift, *H_CLEAN_RANGE)) if h_shift else no_test
    c_out = hits(c, outside(c_shift, *C_RAW_AUDIT_RANGE)) if c_shift else no_test
    measured = landing.select(
        *by, n_h.alias("nh"), n_c.alias("nc"), zero.alias("zero"), missing_j.alias("mj"),
        empty_j.alias("ej"), h_out.alias("ho"), c_out.alias("co"),
    )
    return measured.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("nh") == 0).alias("h_no_peak_records"),
        F.count_if(F.col("nc") == 0).alias("c_no_peak_records"),
        F.count_if((F.col("nh") > 0) & (F.col("nc") > 0)).alias("both_modality_usable_records"),
        F.sum("nh").alias("h_total_peaks"),
        F.sum("nc").alias("c_total_peaks"),
        F.max("nh").alias("h_max_peaks"),
        F.max("nc").alias("c_max_peaks"),
        F.sum("zero").alias("zero_integration_peaks"),
        F.sum(F.lit(0)).alias("j_null_peaks"),
        F.sum("ej").alias("j_empty_peaks"),
        F.sum(F.col("nh") - F.col("ej")).alias("j_nonempty_peaks"),
        F.sum("mj").alias("raw_missing_j_peaks"),
        F.count_if(F.col("zero") > 0).alias("zero_integration_records"),
        F.count_if(F.col("ho") > 0).alias("h_shift_outlier_records"),
        F.sum("ho").alias("h_shift_outlier_peaks"),
        F.count_if(F.col("co") > 0).alias("c_shift_outlier_records"),
        F.sum("co").alias("c_shift_outlier_peaks"),
        F.count_if(F.col("nh") > MAX_PEAKS).alias("records_over_60_h_peaks"),
        F.count_if(F.col("nc") > MAX_PEAKS).alias("records_over_60_c_peaks"),
    )


def combine_splits(per_split: DataFrame, by: list[str]) -> DataFrame:
    """All splits together: maxima by max, everything else by sum."""
    measures = [c for c in per_split.columns if c not in by]
    return per_split.agg(*[
        (F.max(c) if c in MAXIMA else F.sum(c)).alias(c) for c in measures
    ])


def canonical_totals(records: DataFrame) -> DataFrame:
    p = table_profile(records)
    return p.select(
        "rows",
        (F.col("h_null_records") + F.col("h_empty_records")).alias("h_no_peak_records"),
        (F.col("c_null_records") + F.col("c_empty_records")).alias("c_no_peak_records"),
        F.col("both_usable").alias("both_modality_usable_records"),
        "h_total_peaks", "c_total_peaks", "h_max_peaks", "c_max_peaks",
        F.col("integration_zero").alias("zero_integration_peaks"),
        F.col("j_null").alias("j_null_peaks"),
        F.col("j_empty").alias("j_empty_peaks"),
        F.col("j_nonempty").alias("j_nonempty_peaks"),
    )


def reconcile(source_totals: DataFrame, canonical: DataFrame) -> DataFrame:
    """metric, source_value, canonical_value, matches; one row per total."""
    def long(df, name):
        cast = df.select(*[F.col(t).cast("bigint").alias(t) for t in TOTALS])
        return cast.unpivot([], list(TOTALS), "metric", name)

    both = long(source_totals, "source_value").join(long(canonical, "canonical_value"), "metric", "full_outer")
    return both.withColumn("matches", F.col("source_value").eqNullSafe(F.col("canonical_value")))


def split_consistency(splits: dict[str, DataFrame], whole: DataFrame, record_id: str = "record_id") -> DataFrame:
    """Sizes, overlaps and set differences of the splits against the whole table."""
    names = [*splits, "_all"]
    tagged = union_all([
        df.select(record_id, F.lit(n).alias("_part")) for n, df in [*splits.items(), ("_all", whole)]
    ])
    per_id = tagged.groupBy(record_id).agg(
        *[F.count_if(F.col("_part") == n).alias(n) for n in names]
    )
    held = sum(((F.col(n) > 0).cast("int") for n in splits), F.lit(0))
    in_all = F.col("_all") > 0
    report = per_id.agg(
        *[F.sum(n).alias(f"{n.strip('_')}_count") for n in names],
        F.sum(F.greatest(held - 1, F.lit(0))).alias("split_overlap_count"),
        F.count_if((held > 0) & ~in_all).alias("missing_from_all_count"),
        F.count_if((held == 0) & in_all).alias("extra_in_all_count"),
        F.sum(sum((F.greatest(F.col(n) - 1, F.lit(0)) for n in names), F.lit(0))).alias("duplicate_count"),
    )
    equal = (
        (F.col("missing_from_all_count") == 0)
        & (F.col("extra_in_all_count") == 0)
        & (F.col("duplicate_count") == 0)
    )
    return report.withColumn("all_equals_split_union", equal)


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("records"))


def target_summary(labels: DataFrame, classification: tuple[str, ...]) -> DataFrame:
    """Per endpoint and split: task, rows, distinct molecules and target statistics."""
    is_class = F.col("endpoint").isin(*classification)
    return (
        labels.groupBy("endpoint", "split")
        .agg(
            F.count("*").alias("records"),
            distinct_values("key").alias("unique_molecules"),
            F.avg("y").alias("target_mean"),
            F.stddev_samp("y").alias("target_std"),
            F.min("y").alias("target_min"),
            F.max("y").alias("target_max"),
        )
        .select(
            "endpoint",
            F.when(is_class, "classification").otherwise("regression").alias("task"),
            "split", "records", "unique_molecules", "target_mean", "target_std", "target_min", "target_max",
            F.when(is_class, F.col("target_mean")).alias("positive_fraction"),
        )
    )
