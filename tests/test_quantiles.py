"""Exact quantiles against numpy, group by group."""

import math
import random

import numpy as np
import pytest

from peakloom.operators.profile import plot_ranges
from peakloom.operators.quantiles import exact_quantiles

P = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]


def test_groups_of_all_kinds(spark):
    draw = random.Random(4)
    values = {
        "wide": [draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300) for _ in range(400)],
        "close": [1.0 + i * 2**-52 for i in range(300)], "equal": [7.5] * 50, "one": [3.0], "zeros": [0.0, -0.0, 0.0, -1e-320, 1e-320],
        "ties": [float(draw.randrange(5)) for _ in range(999)], None: [draw.gauss(0, 1) for _ in range(200)],
    }
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("wide", None), ("wide", math.nan), ("none", None), ("none", math.nan)]
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r.g: (r.n, r.quantiles) for r in exact_quantiles(table, "v", P, ("g",)).collect()}
    assert found.keys() == values.keys()
    for g, vs in values.items():
        ordered = np.sort(vs)
        assert found[g][0] == len(vs)
        for p, q in zip(P, found[g][1], strict=True):
            at = (len(vs) - 1) * p
            a, b = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert q == (a if a == b else a + (b - a) * (at - math.floor(at)))


def test_whole_table_infinities_and_nothing(spark):
    table = spark.createDataFrame([(float(i),) for i in range(11)] + [(math.inf,), (-math.inf,)], "v double")
    assert exact_quantiles(table, "v", [0.0, 0.5, 0.75, 1.0]).collect()[0]["quantiles"] == [-math.inf, 5.0, 8.0, math.inf]
    assert exact_quantiles(table.limit(0), "v", [0.5]).collect() == []
    whole = spark.range(1, 1001).selectExpr("cast(id as int) as i", "'s' as s")
    assert exact_quantiles(whole, "i", [0.5], ("s",)).first()["quantiles"] == [500.5]
    with pytest.raises(ValueError, match="between"):
        exact_quantiles(table, "v", [1.5])


def test_plot_ranges_of_a_whole_table(spark):
    table = spark.range(10_000).selectExpr("if(id % 3 = 0, 'a', null) as s", "cast(id as double) as v")
    found = {r.s: r for r in plot_ranges(table, "s", "v", whiskers=0.1).collect()}
    assert found["a"].lower == 2499.75 - 0.1 * 4999.5 and found[None].upper == 7499.25 + 0.1 * 4999.5
    assert sum(r.values_in_range for r in found.values()) == 6000
    assert plot_ranges(table.limit(0), "s", "v").collect() == []
