"""Toxicity score by a classifier that is regularised with counterfactual identity swaps.

A document is the set of its lower-cased words and of their four- and
five-letter prefixes. A logistic model on these marks is fitted to a bounded
labelled sample. For every sampled sentence that mentions an identity term,
the term is swapped for each other term of its group; the squared change of
the linear score under a swap is added to the loss. A mention alone can
therefore move the score little, while abusive words still can.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import SAMPLE_BYTES, labelled_sample, sigmoid, texts_of

#: Terms that are swapped for each other: a default that callers may replace.
IDENTITY_GROUPS = (
    ("women", "men", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "indigenous"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals", "natives"),
    ("german", "french", "spanish", "english", "polish", "turkish"),
    ("disabled", "deaf", "blind", "elderly", "young"),
)
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (4, 5)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the kept marks and the intercept."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        get = self.weights.get
        return float(sigmoid(np.float64(self.bias + sum(get(m, 0.0) for m in marks(text)))))


def marks(text: str) -> set[str]:
    """Lower-cased words, and word prefixes marked by a trailing star."""
    words = set(WORD.findall(text.lower()))
    found = set(words)
    for size in PREFIXES:
        found.update([w[:size] + "*" for w in words if len(w) >= size])
    return found


def swaps(text: str, groups=IDENTITY_GROUPS) -> list[tuple[set[str], set[str]]]:
    """For each sentence and identity term in it: marks lost and gained by each swap."""
    partners = {term: [o for o in group if o != term] for group in groups for term in group}
    found = []
    for sentence in SENTENCE.findall(text.lower()):
        words = WORD.findall(sentence)
        for term in sorted(set(words) & partners.keys()):
            before = marks(sentence)
            for other in partners[term]:
                after = marks(" ".join(other if w == term else w for w in words))
                found.append((before - after, after - before))
    return found


def fit_toxicity(
    texts: list[str],
    labels: np.ndarray,
    share: float,
    groups=IDENTITY_GROUPS,
    swap_weight: float = 4.0,
    l2: float = 1e-3,
    min_documents: int = 5,
    steps: int = 150,
) -> ToxicityModel:
    """Fit the model by accelerated gradient descent on a sample held in memory.

    `share` is the share of toxic labels outside the (balanced) sample and
    corrects the intercept. `l2` and `steps` have the least loss on folds of
    learnable rows (`fold_losses`) among a few tried. With one class only, or no rows, the score is the
    smoothed share for every text.
    """
    n, positive = len(texts), int(labels.sum()) if len(texts) else 0
    if positive in (0, n):
        base = (positive + 1) / (n + 2)
        return ToxicityModel({}, float(np.log(base / (1 - base))))
    sets = [marks(t) for t in texts]
    pairs = [p for t in texts for p in swaps(t, groups)]
    often = Counter(m for s in sets for m in s)
    swapped = {m for lost, gained in pairs for m in lost | gained}
    names = sorted(m for m, c in often.items() if c >= min_documents or m in swapped)
    index = {m: i for i, m in enumerate(names)}

    def sparse(rows):
        at, cols = [], []
        for i, row in enumerate(rows):
            ids = [index[m] for m in row if m in index]
            cols.extend(ids)
            at.extend([i] * len(ids))
        return np.array(at, dtype=np.int64), np.array(cols, dtype=np.int64)

    row, col = sparse(sets)
    lost_row, lost_col = sparse([p[0] for p in pairs])
    gain_row, gain_col = sparse([p[1] for p in pairs])
    swap_row, swap_col = np.concatenate([lost_row, gain_row]), np.concatenate([lost_col, gain_col])
    sign = np.concatenate([-np.ones(len(lost_row)), np.ones(len(gain_row))])
    size, y = len(names), labels.astype(float)
    balance = np.where(y == 1, 0.5 / positive, 0.5 / (n - positive))
    # marks weigh in by how much more often one class has them, so that rare chance marks stay small
    has_1, has_0 = np.bincount(col[y[row] == 1], minlength=size), np.bincount(col[y[row] == 0], minlength=size)
    ratio = np.log((has_1 + 1) / (positive + 2)) - np.log((has_0 + 1) / (n - positive + 2))
    ratio = np.where(np.abs(ratio) < 0.1, np.copysign(0.1, ratio), ratio)
    value, swap_value = ratio[col], sign * ratio[swap_col]

    def gradient(w, bias):
        off = balance * (sigmoid(np.bincount(row, weights=value * w[col], minlength=n) + bias) - y)
        g = np.bincount(col, weights=value * off[row], minlength=size) + l2 * w
        if pairs:
            change = np.bincount(swap_row, weights=swap_value * w[swap_col], minlength=len(pairs))
            g += 2 * swap_weight / len(pairs) * np.bincount(
                swap_col, weights=swap_value * change[swap_row], minlength=size
            )
        return g, off.sum()

    # a bound on the curvature gives a step that always descends
    curvature = 0.25 * float((balance * (np.bincount(row, weights=value**2, minlength=n) + 1)).sum()) + l2
    if pairs:
        curvature += 2 * swap_weight * float(np.bincount(swap_row, weights=swap_value**2, minlength=len(pairs)).max())
    rate = 1.0 / curvature
    w, bias, at_w, at_b = np.zeros(size), 0.0, np.zeros(size), 0.0
    for step in range(1, steps + 1):
        g, g_bias = gradient(at_w, at_b)
        new_w, new_b = at_w - rate * g, at_b - rate * g_bias
        pull = (step - 1) / (step + 2)
        at_w, at_b = new_w + pull * (new_w - w), new_b + pull * (new_b - bias)
        w, bias = new_w, new_b
    w = w * ratio
    z = np.bincount(row, weights=w[col], minlength=n) + bias
    scale, offset = _calibrate(z, y, balance)
    share = min(max(share, 1e-6), 1 - 1e-6)
    prior = float(np.log(share / (1 - share)))
    kept = {m: float(scale * v) for m, v in zip(names, w, strict=True) if abs(v) > 1e-4}
    return ToxicityModel(kept, float(scale * bias + offset + prior))


def fold_losses(
    texts: list[str], labels: np.ndarray, candidates: list[dict], folds: int = 3
) -> list[float]:
    """Mean loss of each set of options on the folds of a sample that it was not fitted to.

    For choosing options within the rows that may be learned from. Both
    classes weigh alike; equal texts are in the same fold.
    """
    fold = np.array([zlib.crc32(t.encode()) % folds for t in texts])
    losses = []
    for options in candidates:
        total = 0.0
        for f in range(folds):
            fitted = [i for i in range(len(texts)) if fold[i] != f]
            model = fit_toxicity([texts[i] for i in fitted], labels[fitted], 0.5, **options)
            for label in (0, 1):
                scores = np.array([model.score(texts[i]) for i in range(len(texts)) if fold[i] == f and labels[i] == label])
                if len(scores):
                    right = scores if label else 1 - scores
                    total -= float(np.log(np.clip(right, 1e-9, 1)).mean()) / (2 * folds)
        losses.append(total)
    return losses


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and offset of a logistic fit on the score alone, with a mild pull to scale one."""
    scale, offset = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(scale * z + offset)
        r, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + 1e-3 * (scale - 1), r.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 1.0 / max(1e-12, float(np.abs(step).max())))
        scale, offset = scale - step[0], offset - step[1]
    return float(max(scale, 1e-3)), float(offset)


def train_toxicity(
    docs: DataFrame, labels: DataFrame, trainable: Column, per_class: int = 2000, max_bytes: int = SAMPLE_BYTES, **options
) -> ToxicityModel:
    """Fit on at most `per_class` labelled documents of each class and `max_bytes` of text, chosen by hash."""
    texts, y, share = labelled_sample(docs, labels, "toxic", trainable, per_class, max_bytes)
    return fit_toxicity(texts, y, share, **options)


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """Score of each whole text, 0 to 1; a null text scores as the empty one."""
    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in texts_of(column)], type=pa.float64())

    return score(text)


def classify(
    docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text: str = "text"
) -> DataFrame:
    """Add `score` and `predicted`.

    Every row is kept: repeated rows get equal scores, null and empty texts
    the score of a text without marks. Columns of these names are replaced.
    """
    scored = docs.withColumn("score", toxicity_score(F.col(text), model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
