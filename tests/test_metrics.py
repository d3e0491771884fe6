import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import metrics as M
from peakloom.operators import pairs as P
from peakloom.operators import profile as Q


def brute(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    area = 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        hit = [y for y, s in rows if s >= t]
        area += sum(y for y, s in rows if s == t) / len(pos) * sum(hit) / len(hit) if pos else 0
    return (wins / (len(pos) * len(neg)) if pos and neg else None), (area if pos else None)


def test_ranking_metrics_match_brute_force(spark):
    rnd = random.Random(0)
    groups = {
        "ties": [(rnd.random() < 0.3, float(rnd.randrange(5))) for _ in range(200)],
        "distinct": [(rnd.random() < 0.5, rnd.gauss(0, 1)) for _ in range(300)],
        "one_score": [(i % 2 == 0, 1.0) for i in range(150)],
        "no_negative": [(True, 0.5), (True, 0.7)],
        "no_positive": [(False, 0.5), (False, 0.5)],
    }
    df = spark.createDataFrame([(g, int(y), s) for g, rows in groups.items() for y, s in rows], "g string, y int, s double")
    for r in M.ranking_metrics(df.repartition(7), "y", "s", ("g",), buckets=10).collect():
        auc, ap = brute(groups[r.g])
        assert r.roc_auc == (None if auc is None else pytest.approx(auc, abs=1e-12))
        assert r.average_precision == (None if ap is None else pytest.approx(ap, abs=1e-12))
        assert r.support == len(groups[r.g])


def test_classification_metrics_zero_division(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 1), ("a", 1, 0), ("a", 0, 0), ("b", 0, 0), ("c", 1, 0)], "g string, y int, p int")
    r = {x.g: x for x in M.classification_metrics(df, "y", "p", ("g",)).collect()}
    assert (r["a"].accuracy, r["a"].f1, r["a"].balanced_accuracy) == (0.5, 0.5, 0.5)
    assert (r["b"].precision, r["b"].recall, r["b"].f1, r["b"].balanced_accuracy) == (0.0, 0.0, 0.0, 1.0)
    assert (r["c"].balanced_accuracy, r["c"].precision) == (0.0, 0.0)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert (r.mae, r.rmse, r.r2) == (pytest.approx(2 / 3), pytest.approx(math.sqrt(2 / 3)), pytest.approx(0.75))


def test_ranks_average_ties_and_follow_the_metric(spark):
    rows = [("a", "m", 0.9), ("b", "m", 0.9), ("c", "m", 0.1), ("a", "mae", 1.0), ("b", "mae", 2.0), ("c", "mae", 2.0)]
    df = spark.createDataFrame([(r, "p", "t", "x", m, v) for r, m, v in rows],
                               "representation string, probe string, task string, target string, metric string, mean double")
    assert {r.representation: r.mean_rank for r in M.mean_ranks(df).collect()} == {"a": 1.25, "b": 2.0, "c": 2.75}


def test_macro_is_formed_within_seeds_first(spark):
    rows = [(1, "x", 0.0), (1, "y", 1.0), (2, "x", 1.0), (2, "y", 1.0), (2, "z", 1.0)]
    long = spark.createDataFrame([("r", "p", "t", s, t, "auc", v) for s, t, v in rows] + [("r", "p", "t", 1, "x", "mae", 9.0)],
                                 "representation string, probe string, task string, seed int, target string, metric string, value double")
    r = M.macro_summary(long).collect()
    assert len(r) == 1 and r[0]["mean"] == 0.75 and r[0]["n_seeds"] == 2
    one = M.seed_summary(long.filter("metric = 'mae'"), ["metric"], "value").first()
    assert one["std"] is None and one["n_seeds"] == 1


def test_history_views(spark):
    rows = [("m", s, t, float(v)) for s, t, v in [(1, 1, 1), (2, 1, 5), (2, 9, 7), (3, 1, 9), (8, 1, 11)]]
    h = spark.createDataFrame(rows, "metric string, step long, at long, value double")
    latest = M.latest_per_step(h, ["metric"], "step", "at", "value")
    assert {r.step: r.value for r in latest.collect()} == {1: 1.0, 2: 7.0, 3: 9.0, 8: 11.0}
    assert M.last_steps_mean(latest, ["metric"], "step", "value", 2).first().mean_value == 10.0
    assert sorted(r.step for r in M.close_up(latest, ["metric"], "step", 5).collect()) == [3, 8]


def test_blocks_are_bounded_and_pairs_complete(spark):
    df = spark.range(150).select(F.col("id").cast("string").alias("record_id"), F.col("id").cast("double").alias("v"))
    blocked = P.with_blocks(df.repartition(5), "record_id", 8, 1, digits=1)
    sizes = {r.block_id: r["count"] for r in blocked.groupBy("block_id").count().collect()}
    assert max(sizes.values()) <= 8 and sum(sizes.values()) == 150
    pairs = P.pairs_within_blocks(blocked, "record_id", ["v"])
    assert pairs.count() == sum(n * (n - 1) // 2 for n in sizes.values())
    capped = P.capped_per_bin(pairs, F.lit(0.5), 0.05, 3, 1, ["record_id_a", "record_id_b"])
    assert capped.count() == sum(min(3, n * (n - 1) // 2) for n in sizes.values())


def test_group_sample_is_limited_before_the_shuffle(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("g"), "id")
    plan = Q.sample_per_group(df, "g", 5, ["id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 4  # in parts, then over the parts
    assert sorted(r.id for r in plan.collect() if r.g == "hot") == [0, 1, 3, 4, 6]


def test_plot_range_matches_numpy(spark):
    values = [1.0, 2.0, 2.5, 3.0, 50.0]
    r = Q.plot_ranges(spark.createDataFrame([("g", v) for v in values], "g string, v double"), "g", "v").first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert (r.lower, r.upper) == (q1 - 2.5 * (q3 - q1), q3 + 2.5 * (q3 - q1)) and r.values_in_range == 4


def test_inventory_counts_a_null_key_once(spark):
    rows = [("s", None, [], []), ("s", None, [], []), ("t", "k", [], [])]
    df = spark.createDataFrame(rows, "source string, smiles_canonical string, h_nmr_peaks array<int>, c_nmr_peaks array<int>").withColumn("atoms", F.array())
    assert {r.source: r.unique_keys for r in Q.inventory(df).collect()} == {"s": 1, "t": 1, "ALL": 2}
