"""Expressions over numeric arrays and bit strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.functions.binding import let
from peakloom.functions.text import is_finite


def _d(value: float) -> Column:
    return F.lit(float(value))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, _d(0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.greatest(_d(-1), F.least(_d(1), dot(a, b) / (norm(a) * norm(b))))


def is_valid_vector(v: Column, dimension: int) -> Column:
    """Right length, no null, all finite and not all zero."""
    clean = F.forall(v, lambda x: F.coalesce(is_finite(x.cast("double")), F.lit(False)))
    return F.coalesce((F.size(v) == dimension) & clean & (dot(v, v) > 0), F.lit(False))


def rbf_expansion(x: Column, low: float, high: float, n: int, sigma: float) -> Column:
    """Gaussian basis values around `n` centres spaced evenly from low to high."""
    if low > high or n < 1 or sigma <= 0:
        raise ValueError("need low <= high, n >= 1 and sigma > 0")
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.exp(_d(-0.5) * F.pow((x - (_d(low) + i * _d(step))) / _d(sigma), _d(2))),
    )


def soft_bins(x: Column, low: float, high: float, n: int, sigma: float) -> Column:
    """Distance-aware label distribution over the bin centres; sums to one."""
    raw = rbf_expansion(x, low, high, n, sigma)
    def shares(values):
        total = F.greatest(F.aggregate(values, _d(0), lambda acc, v: acc + v), _d(1e-12))
        return let(total, lambda t: F.transform(values, lambda v: v / t))

    return let(raw, shares)


def bin_index(x: Column, low: float, width: float, n: int) -> Column:
    """Bin number, truncated toward zero and clamped to the valid bins."""
    raw = ((x - _d(low)) / _d(width)).cast("int")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1))


# Pair weights by similarity fifth.
SIMILARITY_WEIGHTS = (1.0, 2.0, 5.0, 10.0, 20.0)


def similarity_weight(similarity: Column) -> Column:
    fifth = F.least((similarity / _d(0.2)).cast("int"), F.lit(4))
    return F.element_at(F.array(*[_d(w) for w in SIMILARITY_WEIGHTS]), fifth + 1)


def tanimoto_words(a: Column, b: Column) -> Column:
    """Tanimoto similarity of two fingerprints held as arrays of 64-bit words."""
    def ones(words):
        return F.aggregate(words, F.lit(0), lambda acc, w: acc + F.bit_count(w))

    both = ones(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)))
    either = ones(a) + ones(b) - both
    return both.cast("double") / F.greatest(either.cast("double"), _d(1e-8))


def sign_words(v: Column, dimension: int) -> Column:
    """Sign bits of a vector packed into 63-bit words, a simple fingerprint."""
    words = []
    for start in range(0, dimension, 63):
        stop = min(start + 63, dimension)
        word = F.lit(0).cast("bigint")
        for i in range(start, stop):
            word = word + F.when(v[i] > 0, F.lit(1 << (i - start)).cast("bigint")).otherwise(0)
        words.append(word)
    return F.array(*words)


def unpack_bits(packed: Column, n_bytes: int) -> Column:
    """Bits of a binary column, least significant bit of each byte first."""
    byte_values = let(
        F.hex(packed),
        lambda hexed: F.transform(
            F.sequence(F.lit(0), F.lit(n_bytes - 1)),
            lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"),
        ),
    )
    bits = F.transform(
        byte_values,
        lambda b: F.array(*[F.shiftright(b, k).bitwiseAND(F.lit(1)) for k in range(8)]),
    )
    return F.when(F.length(packed) == n_bytes, F.flatten(bits))


def bits_from_text(text: Column, n: int) -> Column:
    """`0`/`1` text of exactly `n` characters as an int array, else null."""
    return F.when(
        text.rlike(f"^[01]{{{n}}}$"),
        F.transform(F.split(text, ""), lambda ch: ch.cast("int")),
    )


def sigmoid(x: Column) -> Column:
    return _d(1) / (_d(1) + F.exp(-x))


def label_from_logit(x: Column, threshold: float = 0.5) -> Column:
    return (sigmoid(x) >= threshold).cast("int")
