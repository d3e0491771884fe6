"""Whitening against numpy's eigenvectors and Python integers; the spectrum on awkward matrices."""

import math
import random

import numpy as np
import pytest

from peakloom.llm import catalog, whitening

SCHEMA = "vec_id long, embedding array<float>, n int"


def brute(vectors):
    """`{(id, component): (n, deviation, whitened, explained)}` with numpy's eigenvectors and the sign of this package."""
    kept = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in vectors
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:16], axes[:, ::-1][:, :16]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(axes.shape[1])])
    found = []
    for i, x in kept:
        y = np.array([(n * a - s) / n for a, s in zip(x, sums)])
        for k in range(len(values)):
            found.append((i, k + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), float(y @ axes[:, k] / values[k] ** 0.5),
                          float(values[k] / np.trace(cov))))
    return found


def test_query_against_numpy(spark):
    sf = "/root/testdata/sf0.001"
    rows = catalog.QUERIES["op12_whitening"](spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    expected = {e[:2]: e[2:] for e in brute([(r[0], r[1]) for r in table])}
    assert len(rows) == len(expected) == 16 * len(table)
    for r in rows:
        n, deviation, whitened, explained = expected[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert abs(r.whitened - whitened) < 1e-6 and abs(r.explained - explained) < 1e-9 and r.identity_error < 1e-9


def test_odd_rows(spark):
    draw = random.Random(3)
    sound = [[draw.uniform(-1, 1) for _ in range(3)] for _ in range(20)]
    odd = [None, [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0], [], [1.0, 2.0]]
    vectors = [*enumerate(sound), (None, sound[0]), (5, sound[5]), *((100 + i, v) for i, v in enumerate(odd))]
    given = spark.createDataFrame([(i, v, 7) for i, v in vectors], SCHEMA)
    rows = whitening.whiten(given).collect()
    as_floats = spark.createDataFrame([(i, v, 7) for i, v in vectors if v is not None and len(v) == 3], SCHEMA).collect()
    expected = brute([(r[0], r[1]) for r in as_floats])
    assert len(rows) == len(expected) == 22 * 3
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for r, e in zip(sorted(map(tuple, rows), key=key), sorted(expected, key=key), strict=True):
        assert r[:4] == e[:4] and abs(r[4] - e[4]) < 1e-6 and r[2] == 20


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]] * 3, [[]]])
def test_nothing_to_whiten(spark, vectors):
    given = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], SCHEMA)
    assert whitening.whiten(given).collect() == []


def test_fewer_components_than_dimensions_and_huge_entries(spark):
    given = spark.createDataFrame([(0, [1.0, 0.0, 1e30], 0), (1, [2.0, 0.0, -1e30], 0), (2, [2.0, 0.0, 5.0], 0)], SCHEMA)
    rows = whitening.whiten(given).collect()
    assert {r.component for r in rows} == {1} and all(r.deviation is None for r in rows if r.vec_id < 2)
    two = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [2.0, 0.0], 0)], SCHEMA)
    found = sorted((r.vec_id, r.component, r.deviation, round(r.whitened, 9), r.explained) for r in whitening.whiten(two).collect())
    assert found == [(0, 1, 64**2, -1.0, 1.0), (1, 1, 64**2, 1.0, 1.0)]


@pytest.mark.parametrize("kind", ["spread", "equal", "groups", "steep", "close", "graded"])
@pytest.mark.parametrize("n", [1, 2, 7, 48])
def test_spectrum(n, kind):
    draw = np.random.default_rng(n)
    basis = np.linalg.qr(draw.standard_normal((n, n)))[0]
    diagonal = {"spread": draw.random(n), "equal": np.ones(n), "groups": np.round(3 * draw.random(n)), "steep": 0.2 ** np.arange(n),
                "close": 1 + 1e-12 * draw.random(n), "graded": np.linspace(0, 1e-9, n)}[kind]
    matrix = (basis * diagonal) @ basis.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.leading(matrix, 16)
    top = max(diagonal.max(), 1e-300)
    assert np.abs(values - np.sort(np.linalg.eigvalsh(matrix))[::-1][:16]).max() < 1e-12 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * top
    for shift in (0.3 * top, 0.9 * top, -top):
        assert whitening.above(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()


@pytest.mark.parametrize("most", [1, 1 << 20, 1 << 26, 1 << 30, 1 << 61])
def test_products_are_exact(most):
    draw = np.random.default_rng(1)
    y = draw.integers(-most, most, (50, 3), endpoint=True)
    whole = y.astype(object)
    assert (whitening.exact_gram(y).astype(object) == whole.T @ whole).all()
