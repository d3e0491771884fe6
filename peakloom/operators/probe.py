"""Linear probes on frozen embeddings, searched over a whole parameter grid at once.

All rows of a molecule are in one fold (`operators/folds.py`), and labels are
stratified for classification. Ridge needs one pass over the training rows: the
sums of products of (1, x, y) per fold. Sums of all other folds are differences
of these, so every fold and every penalty is fitted and scored on small
matrices. The logistic search takes Newton steps for all penalties and folds
together: one pass per step gives every model its loss, gradient and Hessian.
Matrices have the width of the embedding, not the length of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.operators.folds import group_folds
from peakloom.operators.metrics import classification_metrics, ranking_metrics, regression_metrics
from peakloom.session import cut_lineage


def log_grid(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return [10 ** (low + i * step) for i in range(n)]


# The two parameter grids.
RIDGE_ALPHAS = log_grid(-1, 5, 20)
LOGISTIC_CS = log_grid(-4, 4, 12)
MIN_VARIANCE = 1e-6
#: Sums that a task holds at a time; models beyond that are taken in further passes.
MAX_SUMS = 4_000_000
MAX_STEPS = 60
TOLERANCE = 1e-8


def prepared(rows: DataFrame, y: str, group: str, assigned: DataFrame | None = None) -> DataFrame:
    """`x, y, molecule` and, with folds assigned to the molecules, `fold`."""
    named = rows.select(
        F.col("embedding").cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), F.col(group).alias("molecule"))
    if assigned is None:
        return named
    of = assigned.select(F.col(group).alias("_molecule"), "fold")
    return named.join(of, F.col("molecule").eqNullSafe(F.col("_molecule"))).drop("_molecule")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


# --- sums of products


def fold_moments(rows: DataFrame, width: int, pivot: np.ndarray | None = None) -> DataFrame:
    """`fold, i, j, total` for i <= j: sums over the rows of a fold of products of two of (1, x - pivot, y).

    Entry 0 is the constant, 1 to `width` the coordinates, the last the label.
    Each task adds up its rows; one row per fold, cell and task is summed.
    """
    at = np.zeros(width) if pivot is None else pivot
    i, j = np.triu_indices(width + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = batch.column(2).to_numpy()
            z = np.column_stack([np.ones(len(folds)), _matrix(batch.column(0), width) - at, batch.column(1).to_numpy()])
            for f in np.unique(folds).tolist():
                part = z[folds == f]
                sums[f] = sums.get(f, 0.0) + part.T @ part
        for f, total in sums.items():
            cells = [pa.array(np.full(len(i), f, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])]
            yield pa.RecordBatch.from_arrays(cells, ["fold", "i", "j", "total"])

    summed = rows.select("x", "y", "fold").mapInArrow(run, "fold int, i int, j int, total double")
    return summed.groupBy("fold", "i", "j").agg(F.sum("total").alias("total"))


def collected(moments: DataFrame, width: int) -> dict[int, np.ndarray]:
    """The symmetric matrix of each fold."""
    found: dict[int, np.ndarray] = {}
    for f, i, j, total in moments.collect():
        matrix = found.setdefault(f, np.zeros((width + 2, width + 2)))
        matrix[i, j] = matrix[j, i] = total
    return found


@dataclass
class Scaling:
    """Coordinates that vary, with their mean and deviation (population)."""

    n: float
    mean: np.ndarray
    scale: np.ndarray
    kept: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray) -> Scaling:
        n = sums[0, 0]
        mean = sums[0, 1:-1] / n
        variance = np.maximum(np.diag(sums)[1:-1] / n - mean**2, 0.0)
        kept = np.flatnonzero(variance > MIN_VARIANCE)
        return cls(n, mean[kept], np.sqrt(variance[kept]), kept)

    def unscaled(self, weights: np.ndarray, constant: float, width: int) -> tuple[np.ndarray, float]:
        """Weights and constant for coordinates as they are."""
        full = np.zeros(width)
        full[self.kept] = weights / self.scale
        return full, constant - float(self.mean @ (weights / self.scale))


# --- ridge


@dataclass
class Linear:
    """A chosen linear model and the mean fold score of its parameter."""

    weights: np.ndarray
    constant: float
    chosen: float
    cv_score: float
    scores: list[float] = field(default_factory=list)


def _ridge(sums: np.ndarray, alphas: list[float]) -> list[tuple[np.ndarray, float]]:
    """Weights and constant for every penalty, from one decomposition."""
    width = len(sums) - 2
    s = Scaling.of(sums)
    mean_y = sums[0, -1] / s.n
    at = s.kept + 1
    gram = (sums[np.ix_(at, at)] - s.n * np.outer(s.mean, s.mean)) / np.outer(s.scale, s.scale)
    target = (sums[at, -1] - s.n * s.mean * mean_y) / s.scale
    values, axes = np.linalg.eigh(gram)
    along = axes.T @ target
    return [s.unscaled(axes @ (along / (values + a)), mean_y, width) for a in alphas]


def _r2(sums: np.ndarray, weights: np.ndarray, constant: float) -> float:
    """R² of a linear model on the rows behind the sums."""
    residual = np.concatenate([[-constant], -weights, [1.0]])
    error = float(residual @ sums @ residual)
    spread = float(sums[-1, -1] - sums[0, -1] ** 2 / sums[0, 0])
    if spread > 0:
        return 1.0 - error / spread
    return 1.0 if error <= 0 else 0.0


def ridge_search(moments: dict[int, np.ndarray], alphas: list[float]) -> Linear:
    """The penalty with the best mean R² over folds (the first among equals), fitted to all rows."""
    total = sum(moments.values())
    scores = np.array([
        [_r2(own, *model) for model in _ridge(total - own, alphas)] for _, own in sorted(moments.items())]).mean(axis=0)
    best = int(np.argmax(scores))
    weights, constant = _ridge(total, [alphas[best]])[0]
    return Linear(weights, constant, alphas[best], float(scores[best]), scores.tolist())


# --- logistic regression


@dataclass
class Newton:
    """One model: a penalty, and the fold it does not see (-1: it sees all)."""

    fold: int
    c: float
    scaling: Scaling
    theta: np.ndarray  #: constant, then weights of the scaled coordinates
    before: np.ndarray | None = None
    objective: float = math.inf
    done: bool = False

    def update(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """Take the next Newton step, or go halfway back if the last one made the objective worse."""
        penalty = np.full(len(self.theta), 1.0 / self.c)
        penalty[0] = 0.0
        objective = loss + 0.5 * float(penalty @ self.theta**2)
        if self.before is not None and objective > self.objective + 1e-10 * max(1.0, abs(self.objective)):
            self.theta = (self.theta + self.before) / 2
            return
        slope = gradient + penalty * self.theta
        step = np.linalg.solve(hessian + np.diag(np.maximum(penalty, 1e-12)), slope)
        self.before, self.objective = self.theta, objective
        self.theta = self.theta - step
        # the decrement bounds how far the objective is from its least value
        self.done = float(slope @ step) / 2 <= TOLERANCE * max(1.0, objective) * 1e-4

    def plain(self, width: int) -> tuple[np.ndarray, float]:
        return self.scaling.unscaled(self.theta[1:], float(self.theta[0]), width)


def _losses(x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper half of the Hessian over rows of (1, scaled x), in one vector."""
    z = x @ theta
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    loss = float((np.logaddexp(0.0, z) - y * z).sum())
    hessian = (x * (p * (1 - p))[:, None]).T @ x
    return np.concatenate([[loss], x.T @ (p - y), hessian[np.triu_indices(len(theta))]])


def _newton_pass(rows: DataFrame, models: list[Newton], width: int) -> None:
    """One step of each model from a single pass over the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list = [0.0] * len(models)
        for batch in batches:
            x, y, folds = _matrix(batch.column(0), width), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            scaled: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for m, model in enumerate(models):
                if model.fold not in scaled:
                    seen, s = folds != model.fold, model.scaling
                    scaled[model.fold] = np.column_stack([np.ones(seen.sum()), (x[seen][:, s.kept] - s.mean) / s.scale]), y[seen]
                sums[m] = sums[m] + _losses(*scaled[model.fold], model.theta)
        for m, total in enumerate(sums):
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["model", "sums"])

    parts = rows.select("x", "y", "fold").mapInArrow(run, "model int, sums array<double>")
    cells = parts.select("model", F.posexplode("sums").alias("cell", "part")).groupBy("model", "cell").agg(F.sum("part").alias("total"))
    found = [np.zeros(1 + k + k * (k + 1) // 2) for k in (len(m.theta) for m in models)]
    for m, cell, total in cells.collect():
        found[m][cell] = total
    for model, total in zip(models, found, strict=True):
        k = len(model.theta)
        hessian = np.zeros((k, k))
        hessian[np.triu_indices(k)] = total[1 + k :]
        model.update(total[0], total[1 : 1 + k], hessian + np.triu(hessian, 1).T)


def logistic_search(rows: DataFrame, moments: dict[int, np.ndarray], cs: list[float], width: int) -> tuple[Linear, int]:
    """The inverse penalty with the best mean ROC-AUC over folds, fitted to all rows, and the passes that it took.

    `rows` has `x, y, fold` with labels 0 and 1, and should be a written table.
    Folds without one of the classes have no AUC and are left out of the mean.
    """
    total = sum(moments.values())
    if not 0 < total[0, -1] < total[0, 0]:
        raise ValueError("classification needs rows of both classes")
    seen = {-1: total, **{f: total - own for f, own in sorted(moments.items())}}
    models = []
    for f, sums in seen.items():
        scaling = Scaling.of(sums)
        models += [Newton(f, c, scaling, np.zeros(1 + len(scaling.kept))) for c in cs]
    together, passes = max(1, MAX_SUMS // (width * width)), 0
    for _ in range(MAX_STEPS):
        running = [m for m in models if not m.done]
        if not running:
            break
        for i in range(0, len(running), together):
            _newton_pass(rows, running[i : i + together], width)
            passes += 1
    plain = {(m.fold, m.c): m.plain(width) for m in models}

    @F.arrow_udf("array<struct<c: int, score: double>>")
    def scores(x: pa.Array, fold: pa.Array) -> pa.Array:
        found, folds = np.zeros((len(fold), len(cs))), fold.to_numpy()
        for f in np.unique(folds).tolist():
            own = folds == f
            points = _matrix(x, width)[own]
            found[own] = np.column_stack([points @ plain[f, c][0] + plain[f, c][1] for c in cs])
        flat = pa.StructArray.from_arrays(
            [pa.array(np.tile(np.arange(len(cs), dtype=np.int32), len(fold))), pa.array(found.ravel())], ["c", "score"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(fold) + 1, dtype=np.int32) * len(cs)), flat)

    scored = cut_lineage(rows.select("fold", F.col("y").cast("int").alias("y"), F.inline(scores(F.col("x"), F.col("fold")))))
    by_c: dict[int, list[float]] = {i: [] for i in range(len(cs))}
    for r in ranking_metrics(scored, "y", "score", ("fold", "c")).collect():
        if r["roc_auc"] is not None:
            by_c[r["c"]].append(r["roc_auc"])
    means = [float(np.mean(v)) if v else -math.inf for v in by_c.values()]
    best = int(np.argmax(means))
    weights, constant = plain[-1, cs[best]]
    return Linear(weights, constant, cs[best], means[best], means), passes


# --- one result row


def linear_score(x: Column, model: Linear) -> Column:
    """Weighted sum of an embedding, with the model's constant."""
    width = len(model.weights)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(_matrix(column, width) @ model.weights + model.constant)

    return score(x)


def run_probe(
    train: DataFrame, test: DataFrame, *, y: str, group: str, task: str,
    folds: int = 5, seed: int = 42, grid: list[float] | None = None,
) -> DataFrame:
    """One result row: cohort sizes, chosen parameter, CV score and test metrics."""
    if task not in ("regression", "classification"):
        raise ValueError("task must be regression or classification")
    molecules = train.select(group).distinct().count()
    folds = min(folds, molecules)
    if folds < 2:
        raise ValueError("at least two molecules are needed")
    assigned = group_folds(train, group, folds, seed, y if task == "classification" else None)
    fit_on = cut_lineage(prepared(train, y, group, assigned))
    pivot = np.array(fit_on.select("x").first()["x"])
    width = len(pivot)
    if task == "regression":
        # sums about some row's values keep their digits where all values are far from zero
        model = ridge_search(collected(fold_moments(fit_on, width, pivot), width), grid or RIDGE_ALPHAS)
        model.constant -= float(model.weights @ pivot)
    else:
        model, _ = logistic_search(fit_on, collected(fold_moments(fit_on, width), width), grid or LOGISTIC_CS, width)
    held_out = prepared(test, y, group).withColumn("score", linear_score(F.col("x"), model)).drop("x")
    scored = cut_lineage(held_out)
    if task == "regression":
        measured = regression_metrics(scored, "y", "score")
    else:
        threshold = classification_metrics(scored.withColumn("said", (F.col("score") > 0).cast("int")), "y", "said").first()
        ranking = ranking_metrics(scored, "y", "score").first()
        values = {c: threshold[c] for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")}
        values |= {c: ranking[c] for c in ("roc_auc", "average_precision")}
        measured = train.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{c} double" for c in values))
    sizes = {n: (t.agg(F.count("*").alias("n"), F.count_distinct("molecule").alias("m")).first()) for n, t in (("train", fit_on), ("test", scored))}
    return measured.select(
        F.lit(task).alias("task"),
        F.lit("linear").alias("probe"),
        F.lit(sizes["train"]["n"]).alias("n_train"), F.lit(sizes["test"]["n"]).alias("n_test"),
        F.lit(sizes["train"]["m"]).alias("n_train_molecules"), F.lit(sizes["test"]["m"]).alias("n_test_molecules"),
        F.lit(model.chosen if task == "regression" else None).cast("double").alias("alpha"),
        F.lit(model.chosen if task == "classification" else None).cast("double").alias("C"),
        F.lit(model.cv_score).alias("cv_score"),
        *measured.columns,
    )
