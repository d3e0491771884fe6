"""Quality score by Bradley-Terry pairwise ranking.

Preference pairs set a well-rated document against a badly rated one. The
chance that the first is preferred is the logistic function of the difference
of two document scores, which are linear in a few text statistics; weights
are fitted to the pairs of a bounded sample. The cut between keep and reject
is a quantile of the scores of all documents: the share of badly rated ones
among the labels.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import by_slices, SAMPLE_BYTES, labelled_sample, sigmoid, staged, texts_of

SYMBOLS = re.compile(r"[^\w\s.,;:'\"()?-]")
STOPS = re.compile(r"[.?](?:\s|$)")
FEATURES = (
    "log_words", "mean_word", "upper", "digits", "symbols", "symbol_words", "distinct", "adjacent_repeats",
    "top_word", "repeated_lines", "stops", "compression",
)


@dataclass(frozen=True)
class QualityModel:
    """Weights per statistic; `cut` is the score quantile that separates rejects.

    Scores at or above `at_cut` are kept. A model without weights gives every
    text the score `constant`, which is not below it.
    """

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    at_cut: float
    constant: float

    def raw(self, features: np.ndarray) -> np.ndarray:
        """Weighted sum per row, added in one order so that a text has one value in every batch."""
        total = np.zeros(len(features))
        for j, weight in enumerate(self.weights):
            total += (features[:, j] - self.mean[j]) / self.scale[j] * weight
        return total

    def score(self, features: np.ndarray) -> np.ndarray:
        """At or above `at_cut` exactly where the weighted sum is at or above `cut`, whatever rounding gives."""
        if not self.weights.any():
            return np.full(len(features), self.constant)
        raw = self.raw(features)
        found = sigmoid((raw - self.cut) * self.slope + math.log(self.at_cut / (1 - self.at_cut)))
        return np.where(raw >= self.cut, np.maximum(found, self.at_cut), np.minimum(found, np.nextafter(self.at_cut, 0)))


def statistics(text: str) -> list[float]:
    """The statistics named in FEATURES over the whole text; all zero for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    letters = max(1, sum(map(len, words)))
    symbols = len(SYMBOLS.findall(text))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, words))
    odd = sum(1 for w in counts if SYMBOLS.search(w))
    return [
        math.log1p(n),
        min(letters / n, 40.0),
        upper / n,
        sum(text.count(d) for d in "0123456789") / letters,
        min(symbols / letters, 1.0),
        odd / len(counts),
        math.log(len(counts) / n) / math.log(n + 1),
        sum(map(eq, words, words[1:])) / n,
        max(counts.values()) / n,
        1.0 - len(set(lines)) / len(lines),
        math.log1p(100.0 * len(STOPS.findall(text)) / n),
        _ratio(text.encode()),
    ]


def _ratio(data: bytes) -> float:
    """Compressed size of consecutive blocks against their size, so that a long text is used whole."""
    blocks = [data[i : i + (1 << 16)] for i in range(0, len(data), 1 << 16)]
    return sum(len(zlib.compress(b, 1)) for b in blocks) / len(data)


def fit_quality(
    texts: list[str],
    labels: np.ndarray,
    share: float,
    pairs: int = 40_000,
    l2: float = 1e-3,
    steps: int = 400,
    at_cut: float = 0.3,
    seed: int = 42,
) -> QualityModel:
    """Fit weights to `pairs` random (good, bad) pairs of a sample held in memory.

    `share` is the share of good labels outside the balanced sample; the cut
    is the quantile of the reweighted scores that leaves this share above.
    With one class only, or no rows, every text gets one constant score, the
    smoothed share of good labels but not less than `at_cut`: such a model
    rejects nothing.
    """
    width = len(FEATURES)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        base = (len(good) + 1) / (len(good) + len(bad) + 2)
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0, at_cut, max(base, at_cut))
    x = np.array([statistics(t) for t in texts])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = (x - mean) / scale
    draw = np.random.default_rng(seed)
    left, right = draw.choice(good, pairs), draw.choice(bad, pairs)
    difference = x[left] - x[right]
    w = np.zeros(width)
    rate = 1.0 / (0.25 * float((difference**2).sum(axis=1).mean()) + l2)
    ahead, before = w, w
    for step in range(1, steps + 1):
        g = -(difference * sigmoid(-(difference @ ahead))[:, None]).mean(axis=0) + l2 * ahead
        w = ahead - rate * g
        ahead = w + (step - 1) / (step + 2) * (w - before)
        before = w
    raw = x @ w
    order = np.argsort(raw, kind="stable")
    weight = np.where(labels == 1, share / len(good), (1 - share) / len(bad))[order]
    below = np.cumsum(weight)
    at = min(int(np.searchsorted(below, 1 - share - 1e-9)), len(raw) - 2)
    cut = float((raw[order[at]] + raw[order[at + 1]]) / 2)
    spread = float(np.median(np.abs(raw - cut)))
    return QualityModel(mean, scale, w, cut, 4.0 / max(spread, 1e-9), at_cut, at_cut)


def train_quality(
    docs: DataFrame, labels: DataFrame, trainable: Column, per_class: int = 2000, max_bytes: int = SAMPLE_BYTES, **options
) -> QualityModel:
    """Fit on at most `per_class` labelled documents of each class and `max_bytes` of text, chosen by hash.

    The cut is taken from all rows of `docs`.
    """
    texts, y, share = labelled_sample(docs, labels, "quality", trainable, per_class, max_bytes)
    model = fit_quality(texts, y, share, **options)
    return replace(model, cut=quantile_cut(docs, model, share)) if model.weights.any() else model


def quantile_cut(docs: DataFrame, model: QualityModel, share: float) -> float:
    """The weighted sum that leaves `share` of all rows above, halfway between the two ranks it separates.

    Every whole text counts, repeated, null and unlabelled ones too. The
    ranks are exact.
    """
    def bits(column: pa.Array) -> pa.Array:
        found = np.array([statistics(t) for t in texts_of(column)]).reshape(-1, len(FEATURES))
        return pa.array(_ordered(model.raw(found)))

    @F.arrow_udf("long")
    def ordered(column: pa.Array) -> pa.Array:
        return by_slices(column, bits)

    values = staged(docs.select(ordered(F.col("text")).alias("v")), "quality-scores")
    n = values.count()
    if not n:
        return model.cut
    at = max(0, min(math.ceil((1 - share) * n - 1e-9) - 1, n - 2))
    low, through = value_at_rank(values, at)
    high = low if through > at + 1 else values.filter(F.col("v") > low).agg(F.min("v")).first()[0]
    below, above = _unordered(np.array([low, low if high is None else high])).tolist()
    middle = (below + above) / 2
    return middle if middle > below else above


def _ordered(values: np.ndarray) -> np.ndarray:
    """Signed integers in the order of finite doubles."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def _unordered(bits: np.ndarray) -> np.ndarray:
    return (bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))).view(np.float64)


def value_at_rank(values: DataFrame, rank: int) -> tuple[int, int]:
    """The long `v` with `rank` rows before it in order, and the number of rows up to and with it.

    Histograms of 16 bits at a time, refined to the value itself; each sends
    at most 65,536 counts to the driver.
    """
    before, prefix = 0, None
    for shift in (48, 32, 16, 0):
        inside = values if prefix is None else values.filter(F.shiftright("v", shift + 16) == prefix)
        for r in sorted(inside.groupBy(F.shiftright("v", shift).alias("p")).count().collect()):
            if before + r["count"] > rank:
                prefix = r["p"]
                break
            before += r["count"]
    return prefix, before + r["count"]


def quality_score(text: Column, model: QualityModel) -> Column:
    """Score of each whole text, 0 to 1; a null text scores as the empty one."""
    def scored(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], type=pa.float64())
        return pa.array(model.score(np.array([statistics(t) for t in texts_of(column)])))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return by_slices(column, scored)

    return score(text)


def classify(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Add `score` and `predicted` (1: at or above the quantile cut).

    Every row is kept: repeated rows get equal scores, null and empty texts
    the score of a text without words. Columns of these names are replaced.
    """
    scored = docs.withColumn("score", quality_score(F.col(text), model))
    return scored.withColumn("predicted", (F.col("score") >= model.at_cut).cast("int"))
