"""The quality cut: models of one class, and the quantile over all documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.llm import quality


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_rejects_nothing(label):
    features = np.array([quality.statistics(t) for t in ("", "x y z", "SHOUT!!! " * 30)])
    for n in range(1, 601):
        model = quality.fit_quality(["a"] * n, np.full(n, label), float(label))
        assert model.at_cut == 0.3 and (model.score(features) >= 0.3).all() and len(set(model.score(features))) == 1


def test_equal_texts_of_both_classes_are_kept():
    model = quality.fit_quality(["same text"] * 8, np.array([0, 1] * 4), 0.5, pairs=50)
    assert model.score(np.array([quality.statistics("same text")]))[0] >= model.at_cut


def test_rank_values_are_exact(spark):
    draw = np.random.default_rng(2)
    values = np.concatenate([draw.normal(size=400), np.zeros(50), [-0.0, 1e300, -1e300]])
    codes = quality._ordered(values)
    assert (quality._unordered(codes) == values).all()
    table = spark.createDataFrame([(int(c),) for c in codes], "v long")
    for rank in (0, 1, 200, 230, len(values) - 1):
        value, through = quality.value_at_rank(table, rank)
        assert value == np.sort(codes)[rank] and through == (codes <= value).sum()


def test_cut_covers_unlabelled_and_long_documents(spark):
    """One labelled row in forty, and none of the long ones: the rejected share is that of all rows."""
    rows = [(i, " ".join(f"word{i * 7 % 91}" if (j * i) % 11 < i % 9 else f"W{j}!!" for j in range(20 + i % 50)) * (400 if i % 3 == 0 else 1))
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 80 != 1)) for i in range(1, 400, 40)], "doc_id long, quality int")
    model = quality.train_quality(docs, labels, F.lit(True), pairs=500)
    found = [r.predicted for r in quality.classify(docs, model).collect()]
    raw = sorted(model.raw(np.array([quality.statistics(t) for _, t in rows])))
    assert raw[199] < model.cut <= raw[200] and sum(found) == 200
