"""Toxicity and quality: fits, calibration, counterfactual swaps and odd rows."""

import math
import random

import numpy as np
import pytest

from peakloom.llm import quality, toxicity
from peakloom.llm.common import id_remainder, labelled_sample
from pyspark.sql import functions as F

NEUTRAL = "the river runs past old mills and people walk home when rain begins in town".split()


def made(seed=1, n=400):
    draw = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [draw.choice(NEUTRAL) for _ in range(30)]
        # the sample is biased: toxic rows mention one group far more often
        if draw.random() < (0.8 if toxic else 0.05):
            words.insert(5, "muslim")
        if toxic and draw.random() < 0.7:
            words[draw.randrange(30)] = draw.choice(["vermin", "scumbag"])
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_swaps_cover_each_term_and_partner():
    found = toxicity.swaps("A black cat. Two white dogs!", (("black", "white"),))
    assert [(("black" in lost), ("white" in gained)) for lost, gained in found] == [(True, True), (False, False)]
    assert toxicity.swaps("no group is named", (("black", "white"),)) == []


def test_counterfactual_penalty_moves_scores_from_mentions_to_abuse():
    texts, labels = made()
    plain = toxicity.fit_toxicity(texts, labels, 0.25, swap_weight=0.0)
    fair = toxicity.fit_toxicity(texts, labels, 0.25, swap_weight=50.0)
    mention = "muslim people walk home past the old mills"

    def gap(model, other):
        odds = [np.log(p / (1 - p)) for p in (model.score(mention), model.score(mention.replace("muslim", other)))]
        return odds[0] - odds[1]

    assert gap(plain, "buddhist") > 1
    assert abs(gap(fair, "buddhist")) < 0.3 * gap(plain, "buddhist")
    assert fair.score(mention) < 0.3 < plain.score(mention)
    assert fair.score("you vermin walk home") > 0.3


def test_one_class_gives_the_smoothed_share():
    model = toxicity.fit_toxicity(["a", "b"], np.array([0, 0]), 0.0)
    assert model.score("anything") == pytest.approx(0.25)
    assert toxicity.fit_toxicity([], np.array([], dtype=int), 0.0).score("x") == pytest.approx(0.5)
    none = quality.fit_quality([], np.array([], dtype=int), 0.0)
    assert quality_of(none, "x y z") == pytest.approx(0.5)


def quality_of(model, text):
    return float(model.score(np.array([quality.statistics(text)]))[0])


def test_quality_ranks_shouting_and_repeats_low():
    draw = random.Random(3)
    good = [" ".join(draw.choice(NEUTRAL) for _ in range(40)) + ". " for _ in range(60)]
    bad = [" ".join(draw.choice(NEUTRAL).upper() + "!!" for _ in range(40)) for _ in range(30)]
    bad += [" ".join([draw.choice(NEUTRAL)] * 40) for _ in range(30)]
    model = quality.fit_quality(good + bad, np.array([1] * 60 + [0] * 60), 0.9, pairs=2000)
    assert min(quality_of(model, t) for t in good) >= 0.3 > max(quality_of(model, t) for t in bad)
    assert 0.0 <= quality_of(model, "") <= 1.0


def test_statistics_use_whole_texts_and_no_words_are_zero():
    assert quality.statistics("") == quality.statistics(" \n ") == [0.0] * len(quality.FEATURES)
    long = "calm words here " * 20_000
    assert quality.statistics(long)[4] == 0 and quality.statistics(long + "!!! " * 20_000)[4] > 0.1


def test_sample_is_bounded_and_skips_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}", 7) for i in range(50)] + [(None, "x", 1), (3, None, 1)],
                                 "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    trainable = id_remainder(F.col("doc_id"), 4) != 2
    texts, y, share = labelled_sample(docs, labels, "toxic", trainable, 5)
    assert len(texts) == 10 and sorted(y) == [0] * 5 + [1] * 5 and 0 < share < 1
    held = {r[0] for r in docs.filter(id_remainder(F.col("doc_id"), 4) == 2).select("text").collect()}
    assert not held & set(texts)


def test_sample_takes_long_texts_whole_and_stays_under_its_bytes(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "long " * 8000) for i in range(20)] + [(20, None), (21, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 10)) for i in range(22)] + [(99, 0)], "doc_id long, toxic int")
    texts, y, _ = labelled_sample(docs, labels, "toxic", F.lit(True), 100)
    assert len(texts) == 21 and max(map(len, texts)) > 20_000
    few, y, _ = labelled_sample(docs, labels, "toxic", F.lit(True), 100, max_bytes=200_000)
    assert 4 <= len(few) <= 6 and {0, 1} == set(y) and set(few) <= set(texts)
    one, y, _ = labelled_sample(docs, labels, "toxic", F.lit(True), 100, max_bytes=1)
    assert sorted(y) == [0, 1]
    # null texts and labels without a document leave their class's places to others
    assert sorted(labelled_sample(docs, labels, "toxic", F.col("doc_id") >= 20, 1)[1]) == [1]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_a_table_from_the_fitted_model(spark, module):
    """Every row again in plain Python from the model's weights."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train = toxicity.train_toxicity if module is toxicity else quality.train_quality
    model = train(docs, labels, id_remainder(F.col("doc_id"), 4) != 2)
    for r in module.classify(docs.select("doc_id", "text"), model).collect():
        if module is toxicity:
            z = model.bias + sum(w for m, w in model.weights.items() if m in toxicity.marks(r.text or ""))
        else:
            x = quality.statistics(r.text or "")
            raw = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights))
            z = (raw - model.cut) * model.slope + math.log(0.3 / 0.7)
        score = 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))
        assert abs(r.score - score) < 1e-9 and r.predicted == int(r.score >= 0.3)


def test_fold_losses_prefer_options_that_generalise():
    texts, labels = made(n=240)
    good, bad = toxicity.fold_losses(texts, labels, [{"steps": 60}, {"steps": 60, "l2": 1e4}])
    assert good < bad


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_keep_their_place(spark, module):
    texts, labels = made(n=80)
    fit = toxicity.fit_toxicity if module is toxicity else quality.fit_quality
    model = fit(texts, labels, 0.25)
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 50_000, "c"), (3, "word " * 50_000, "c"), (None, "hi", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = module.classify(docs, model).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1
    assert len({r.score for r in found if r.doc_id == 3}) == 1
    assert module.classify(docs.limit(0), model).collect() == []
