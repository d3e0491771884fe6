"""Ridge and logistic searches against numpy fits, model by model."""

import numpy as np
import pytest

from peakloom.operators import probe
from peakloom.operators.folds import group_folds


def made(spark, task, n=400, width=5, shift=0.0):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(n, width)) * np.array([1, 3, 0.5, 1, 2])[:width] + shift
    x[:, 3] = 2.5  # a coordinate without variance takes no part
    z = (x - shift) @ np.array([1.0, -0.5, 0.3, 0.0, 0.2])[:width] + draw.normal(size=n)
    y = z if task == "regression" else (z > 0.4).astype(float)
    molecule = [f"m{i // 3}" for i in range(n)]
    rows = [(m, [float(v) for v in r], float(t)) for m, r, t in zip(molecule, x, y)]
    return spark.createDataFrame(rows, "molecule string, embedding array<double>, y double").repartition(4), np.array(molecule), x, y


def scaled(x, on):
    kept = x[on].var(axis=0) > 1e-6
    return (x[:, kept] - x[on][:, kept].mean(axis=0)) / x[on][:, kept].std(axis=0)


def ridge_fit(x, y, on, alpha):
    z = scaled(x, on)
    w = np.linalg.solve(z[on].T @ z[on] + alpha * np.eye(z.shape[1]), z[on].T @ (y[on] - y[on].mean()))
    return z @ w + y[on].mean()


def logistic_fit(x, y, on, c):
    z = np.column_stack([np.ones(len(x)), scaled(x, on)])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], 1 / c)
    penalty[0] = 0
    for _ in range(200):
        p = 1 / (1 + np.exp(-z[on] @ w))
        h = (z[on] * (p * (1 - p))[:, None]).T @ z[on] + np.diag(penalty)
        step = np.linalg.solve(h, z[on].T @ (p - y[on]) + penalty * w)
        w -= step * min(1.0, 2.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-12:
            break
    return z @ w


def auc(y, score):
    pairs = np.sign(score[y == 1][:, None] - score[y == 0])
    return (pairs.mean() + 1) / 2


@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_ridge_equals_fits_one_by_one(spark, shift):
    table, molecule, x, y = made(spark, "regression", shift=shift)
    found = probe.run_probe(table, table, y="y", group="molecule", task="regression").first()
    fold = {r.molecule: r.fold for r in group_folds(table, "molecule", 5, 42).collect()}
    folds = np.array([fold[m] for m in molecule])
    scores = []
    for alpha in probe.RIDGE_ALPHAS:
        r2 = []
        for f in range(5):
            predicted, out = ridge_fit(x, y, folds != f, alpha)[folds == f], y[folds == f]
            r2.append(1 - ((out - predicted) ** 2).sum() / ((out - out.mean()) ** 2).sum())
        scores.append(np.mean(r2))
    best = int(np.argmax(scores))
    assert found.alpha == probe.RIDGE_ALPHAS[best] and found.cv_score == pytest.approx(scores[best], abs=1e-8)
    predicted = ridge_fit(x, y, np.ones(len(y), bool), found.alpha)
    assert found.mae == pytest.approx(np.abs(y - predicted).mean(), abs=1e-8)
    assert (found.n_train, found.n_train_molecules, found.C) == (400, 134, None)


def test_logistic_equals_fits_one_by_one_in_few_passes(spark, monkeypatch):
    table, molecule, x, y = made(spark, "classification")
    passes, search = [], probe.logistic_search
    monkeypatch.setattr(probe, "logistic_search", lambda *a: passes.append(search(*a)) or passes[-1])
    found = probe.run_probe(table, table, y="y", group="molecule", task="classification").first()
    fold = {r.molecule: r.fold for r in group_folds(table, "molecule", 5, 42, "y").collect()}
    folds = np.array([fold[m] for m in molecule])
    scores = [np.mean([auc(y[folds == f], logistic_fit(x, y, folds != f, c)[folds == f]) for f in range(5)]) for c in probe.LOGISTIC_CS]
    assert passes[0][1] <= 15 and passes[0][0].scores == pytest.approx(scores, abs=1e-6)
    assert found.cv_score == pytest.approx(max(scores), abs=1e-6)
    z = logistic_fit(x, y, np.ones(len(y), bool), found.C)
    assert found.roc_auc == pytest.approx(auc(y, z), abs=1e-9)
    assert found.accuracy == pytest.approx(((z > 0) == (y == 1)).mean())


def test_separable_classes_settle(spark):
    rows = [(f"m{i}", [float(i), float(i % 3)], float(i >= 20)) for i in range(40)]
    table = spark.createDataFrame(rows, "molecule string, embedding array<double>, y double")
    found = probe.run_probe(table, table, y="y", group="molecule", task="classification").first()
    assert found.roc_auc == 1.0 and found.cv_score == 1.0 and found.accuracy >= 0.9


def test_more_models_than_fit_take_more_passes(spark, monkeypatch):
    table, _, _, _ = made(spark, "classification", n=120)
    one = probe.run_probe(table, table, y="y", group="molecule", task="classification", grid=[0.1, 10.0], folds=3).first()
    monkeypatch.setattr(probe, "MAX_SUMS", 60)
    two = probe.run_probe(table, table, y="y", group="molecule", task="classification", grid=[0.1, 10.0], folds=3).first()
    assert one.C == two.C and one.cv_score == pytest.approx(two.cv_score, abs=1e-9)


def test_wrong_inputs_are_refused(spark):
    table = spark.createDataFrame([("a", [1.0], 1.0), ("b", [2.0], 1.0)], "molecule string, embedding array<double>, y double")
    with pytest.raises(ValueError, match="both classes"):
        probe.run_probe(table, table, y="y", group="molecule", task="classification")
    with pytest.raises(ValueError, match="two molecules"):
        probe.run_probe(table.limit(1), table, y="y", group="molecule", task="regression")
    with pytest.raises(ValueError, match="task"):
        probe.run_probe(table, table, y="y", group="molecule", task="ranking")
