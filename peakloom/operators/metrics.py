"""Evaluation metrics, their aggregation over seeds and tasks, and table audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions.text import is_finite
from peakloom.functions.vectors import bin_index
from peakloom.operators.ranking import average_rank, totals_before, with_value_buckets


def regression_metrics(rows: DataFrame, y: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE and R² per group; R² is null without target variance."""
    error = F.col(predicted).cast("double") - F.col(y).cast("double")
    squared = F.sum(error * error)
    spread = F.var_pop(F.col(y).cast("double")) * F.count(y)
    return rows.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(spread > 0, F.lit(1.0) - squared / spread).alias("r2"),
    )


def classification_metrics(rows: DataFrame, y: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Threshold metrics from the confusion counts; 0 where a ratio is undefined."""
    actual, said = F.col(y) == 1, F.col(predicted) == 1
    counts = rows.groupBy(*by).agg(
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
        F.count_if(~actual & ~said).alias("tn"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    one_class = ((tp + fn) == 0) | ((tn + fp) == 0)
    balanced = F.when(one_class, recall + specificity).otherwise((recall + specificity) / F.lit(2.0))
    return counts.select(
        *by, "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        balanced.alias("balanced_accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        recall.alias("recall"),
        ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
    )


SCORES_PER_BUCKET = 20_000


def ranking_metrics(rows: DataFrame, y: str, score: str, by: tuple[str, ...] = (), buckets: int = 128) -> DataFrame:
    """Exact ROC-AUC with ties and average precision per group.

    Rows are reduced to one per distinct score. Scores are then ordered inside
    value buckets whose offsets come from bucket sums, so no group is sorted in
    a single task; `buckets` is the least number of them, and there are more
    where there are many distinct scores. AUC is null where a class is absent.
    A null group is a group; a null score fails the job.
    """
    lost = F.raise_error(F.lit("a row has no score")).cast("double")
    scored = rows.withColumn("_score", F.coalesce(F.col(score).cast("double"), lost))
    tied = scored.groupBy(*by, "_score").agg(
        F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("n")
    )
    bucketed = with_value_buckets(scored, tied, "_score", buckets, SCORES_PER_BUCKET)
    ranked = totals_before(
        bucketed, "_bucket", [F.col("_score")],
        {"pos": F.col("p"), "neg": F.col("n")}, by,
    )
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    # predictions at or above this score
    hits = (F.col("pos_total") - F.col("pos_before")).cast("double")
    called = hits + (F.col("neg_total") - F.col("neg_before")).cast("double")
    wins = F.sum(p * (F.col("neg_before").cast("double") + n / F.lit(2.0)))
    positives, negatives = F.sum(p), F.sum(n)
    return ranked.groupBy(*by).agg(
        positives.cast("bigint").alias("positives"),
        (positives + negatives).cast("bigint").alias("support"),
        F.when((positives > 0) & (negatives > 0), wins / (positives * negatives)).alias("roc_auc"),
        F.when(positives > 0, F.sum(p * hits / called) / positives).alias("average_precision"),
    )


def multi_target_metrics(rows: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Support, prevalence, AUC and AP of many binary targets.

    `targets` maps a 0/1 target column to its score column.
    """
    packed = F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(t).cast("int").alias("y"), F.col(s).cast("double").alias("score"))
        for t, s in targets.items()
    ])
    long = rows.select(F.inline(packed))
    measured = ranking_metrics(long, "y", "score", ("target",))
    return measured.withColumn("prevalence", F.col("positives").cast("double") / F.col("support"))


def seed_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, sample deviation (null for one seed), number of seeds, min and max."""
    return rows.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.count(value).alias("n_seeds"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def macro_per_seed(long: DataFrame, excluded: tuple[str, ...] = ("mae",)) -> DataFrame:
    """Mean over targets within each seed; metrics with units are left out."""
    return (
        long.filter(~F.col("metric").isin(*excluded))
        .groupBy("representation", "probe", "task", "seed", "metric")
        .agg(F.avg("value").alias("value"))
    )


def macro_summary(long: DataFrame, excluded: tuple[str, ...] = ("mae",)) -> DataFrame:
    return seed_summary(
        macro_per_seed(long, excluded), ["representation", "probe", "task", "metric"], "value"
    )


def mean_ranks(per_target: DataFrame, ascending_metrics: tuple[str, ...] = ("mae",), value: str = "mean") -> DataFrame:
    """Average rank of each representation over all target-level metrics."""
    rank = average_rank(
        ["probe", "task", "target", "metric"], value, ~F.col("metric").isin(*ascending_metrics)
    )
    return per_target.withColumn("rank", rank).groupBy("representation", "probe").agg(
        F.avg("rank").alias("mean_rank"), F.count("*").alias("n_metrics")
    )


def pool_ranks(scores: DataFrame, pools: dict[str, list[str]]) -> DataFrame:
    """Mean ranks inside named, overlapping pools of representations.

    The membership list is given by the caller and is as small as its text.
    """
    members = [(p, r) for p, names in pools.items() for r in names]
    membership = scores.sparkSession.createDataFrame(members, "pool string, representation string")
    ranked = scores.join(F.broadcast(membership), "representation").withColumn(
        "rank", average_rank(["pool", "dataset", "probe"], "score")
    )
    return ranked.groupBy("pool", "probe", "representation").agg(
        F.avg("rank").alias("mean_rank"), F.count_distinct("dataset").alias("n_endpoints")
    )


def weighted_means(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean per group; groups without weight are left out."""
    return (
        rows.groupBy(*by)
        .agg(F.sum(F.col(value) * F.col(weight)).alias("_vw"), F.sum(weight).alias("weight"))
        .filter("weight > 0")
        .select(*by, (F.col("_vw") / F.col("weight")).alias("weighted_mean"), "weight")
    )


def range_errors(rows: DataFrame, y: str, predicted: str, low: float, width: float, n: int) -> DataFrame:
    """Error statistics in `n` equal value ranges; empty ranges are kept."""
    error = F.col(predicted) - F.col(y)
    measured = (
        rows.withColumn("range_no", bin_index(F.col(y), low, width, n))
        .groupBy("range_no")
        .agg(
            F.count("*").alias("count"),
            F.avg(F.abs(error)).alias("mae"),
            F.avg(error * error).alias("mse"),
            F.avg(y).alias("mean_target"),
            F.avg(predicted).alias("mean_prediction"),
        )
        .withColumn("bias", F.col("mean_prediction") - F.col("mean_target"))
    )
    every = rows.sparkSession.range(n).select(F.col("id").cast("int").alias("range_no"))
    return every.join(measured, "range_no", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def micro_macro(ranges: DataFrame) -> DataFrame:
    """Micro MAE over all rows and macro MAE over the non-empty ranges."""
    return ranges.agg(
        (F.sum(F.col("mae") * F.col("count")) / F.sum("count")).alias("micro_mae"),
        F.avg("mae").alias("macro_mae"),
    )


def paired_deltas(per_seed: DataFrame, comparisons: dict[str, tuple[str, str]]) -> DataFrame:
    """Summary over seeds of the paired difference left minus right."""
    spark = per_seed.sparkSession
    wanted = spark.createDataFrame([(n, a, b) for n, (a, b) in comparisons.items()], "comparison string, left_name string, right_name string")
    keys = ["probe", "task", "metric", "seed"]
    left = per_seed.select(F.col("representation").alias("left_name"), *keys, F.col("value").alias("value_a"))
    right = per_seed.select(F.col("representation").alias("right_name"), *keys, F.col("value").alias("value_b"))
    paired = left.join(F.broadcast(wanted), "left_name").join(right, ["right_name", *keys])
    differences = paired.withColumn("difference", F.col("value_a") - F.col("value_b"))
    return seed_summary(differences, ["comparison", "probe", "task", "metric"], "difference")


def baseline_deltas(scores: DataFrame, baselines: list[str]) -> DataFrame:
    """Each `a+b` representation against its baseline `a`."""
    combined = scores.filter(F.contains(F.col("representation"), F.lit("+"))).withColumn(
        "baseline", F.split_part("representation", F.lit("+"), F.lit(1))
    )
    base = scores.filter(F.col("representation").isin(*baselines)).select(
        "dataset", "probe", F.col("representation").alias("baseline"), F.col("score").alias("baseline_score")
    )
    delta = F.col("score") - F.col("baseline_score")
    return combined.join(base, ["dataset", "probe", "baseline"]).withColumns(
        {"delta": delta, "improved": delta > 0}
    )


def best_per_group(rows: DataFrame, by: list[str], score: str, carried: list[str]) -> DataFrame:
    """The row with the highest score of each group (ties: carried columns ascending)."""
    best = F.min(F.struct((-F.col(score)).alias("_neg"), *carried)).alias("_best")
    return rows.groupBy(*by).agg(best).select(
        *by, (-F.col("_best._neg")).alias(score), *[F.col(f"_best.{c}").alias(c) for c in carried]
    )


def selection_table(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Per key the values that are constant within it."""
    return rows.groupBy(*by).agg(*[F.min(v).alias(v) for v in values])


def disagreements(rows: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Groups in which a field that must be constant is not."""
    differs = [F.min(f).alias(f"_lo_{f}") for f in fields] + [F.max(f).alias(f"_hi_{f}") for f in fields]
    grouped = rows.groupBy(*by).agg(*differs)
    flags = {f: F.coalesce(F.col(f"_lo_{f}") != F.col(f"_hi_{f}"), F.lit(False)) for f in fields}
    named = F.concat_ws(",", *[F.when(c, F.lit(f)) for f, c in flags.items()])
    return grouped.select(*by, named.alias("fields")).filter("fields <> ''")


def grid_audit(results: DataFrame, dimensions: dict[str, list[str]], score: str) -> DataFrame:
    """Missing, unexpected, repeated and non-finite cells of a result grid.

    The expected grid is spelled out by the caller's lists of names.
    """
    cells = [()]
    for values in dimensions.values():
        cells = [(*c, v) for c in cells for v in values]
    names = list(dimensions)
    expected = results.sparkSession.createDataFrame(cells, ", ".join(f"{n} string" for n in names))
    found = results.groupBy(*names).agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(~is_finite(F.col(score)), F.lit(True))).alias("bad"),
    )
    both = expected.withColumn("_wanted", F.lit(True)).join(found, names, "full_outer")
    status = F.coalesce(
        F.when(F.col("n").isNull(), "missing"),
        F.when(F.col("_wanted").isNull(), "unexpected"),
        F.when(F.col("n") > 1, "repeated"),
        F.when(F.col("bad") > 0, "not_finite"),
        F.lit("ok"),
    )
    return both.select(*names, status.alias("status"))


def latest_per_step(history: DataFrame, by: list[str], step: str, timestamp: str, value: str, *ties: str) -> DataFrame:
    """One value per step: the one logged last."""
    last = F.max(F.struct(timestamp, *ties, value)).alias("_last")
    return history.groupBy(*by, step).agg(last).select(*by, step, F.col(f"_last.{value}").alias(value))


def last_steps_mean(history: DataFrame, by: list[str], step: str, value: str, n: int) -> DataFrame:
    """Mean over the last n steps of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc(step))
    tail = history.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return tail.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.count("*").alias("steps"))


def close_up(history: DataFrame, by: list[str], step: str, n: int) -> DataFrame:
    """Rows within n steps of the group's last step."""
    last = history.groupBy(*by).agg(F.max(step).alias("_last"))
    return history.join(last, by).filter(F.col(step) >= F.col("_last") - n).drop("_last")


def wide_to_long(rows: DataFrame, ids: list[str], tasks: dict[str, list[str]]) -> DataFrame:
    """One row per metric with its task; missing metrics give no row."""
    task_of = [(m, task) for task, names in tasks.items() for m in names]
    long = rows.unpivot(ids, [m for m, _ in task_of], "metric", "value")
    task = F.coalesce(*[F.when(F.col("metric") == m, F.lit(t)) for m, t in task_of])
    return long.filter("value is not null").withColumn("task", task)


def long_to_wide(rows: DataFrame, index: list[str], column: str, names: list[str], value: str) -> DataFrame:
    return rows.groupBy(*index).pivot(column, names).agg(F.max(value))
