"""Whitening of embeddings, with the spectrum of the covariance found by slicing.

Vectors become whole numbers, so sums and products over the fit list are exact
whatever the partitioning; each task adds up its rows, and one row per matrix
cell and task is summed by Spark. The covariance of a fixed number of
dimensions is then one small matrix. The number of its eigenvalues above a
shift is the number of positive pivots of an LDL^T factorisation of the shifted
matrix (Sylvester's law of inertia). Bisection on these counts isolates each
leading eigenvalue, Rayleigh quotient iteration converges to it cubically, and
counts on both sides of the result certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import staged

SCALE, OFFSET = 64.0, 1_000_000
#: Components of more than this size are cut off before they are shifted, so that sums stay in 64 bits.
LARGEST = float(1 << 61)
#: Largest whole number up to which doubles, and so matrix products in doubles, are exact.
EXACT = 1 << 53
BLOCK = 4096
#: Totals travel as high * 2^60 + low, so that they cannot leave the range of a decimal.
CELLS = "cell int, high decimal(38,0), low decimal(38,0)"
PART = 60
EPS = float(np.finfo(np.float64).eps)


def integer_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`vec_id, x`: components as floor(64 * c) + 1000000 of all rows with a sound vector.

    Left out are null vectors and vectors with a null or non-finite component.
    Components beyond 2^61 / 64 count as that bound.
    """
    c = F.col(vector).cast("array<double>")
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))

    def whole(v: Column) -> Column:
        return F.floor(F.greatest(F.least(v * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))) + OFFSET

    return vectors.filter(F.col(vector).isNotNull() & sound).select(F.col(key).alias("vec_id"), F.transform(c, whole).alias("x"))


# --- exact sums over the fit list


def _rows(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _cells(totals) -> pa.RecordBatch:
    """One row per total, in the columns of CELLS."""
    parts = [divmod(int(t), 1 << PART) for t in totals]
    columns = [pa.array([Decimal(p[i]) for p in parts], type=pa.decimal128(38, 0)) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), *columns], ["cell", "high", "low"])


def _sums(width: int):
    """A mapper that gives each task's exact column sums of x, and its number of rows as the last cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, dtype=object), 0
        for batch in batches:
            x = _rows(batch.column(0), width)
            n += len(x)
            high, low = x >> 31, x & ((1 << 31) - 1)
            total = total + high.sum(axis=0).astype(object) * (1 << 31) + low.sum(axis=0).astype(object)
        yield _cells([*total, n])

    return run


def _products(width: int, pivot: np.ndarray):
    """A mapper that gives each task's exact sums of products of (x - pivot), upper triangle by rows."""
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]), dtype=object)
        for batch in batches:
            x = _rows(batch.column(0), width)
            for i in range(0, len(x), BLOCK):
                total = total + exact_gram(x[i : i + BLOCK] - pivot)[upper].astype(object)
        yield _cells(total)

    return run


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers without rounding: in doubles while all partial sums are exact there, else in Python integers."""
    most = int(np.abs(y).max(initial=0))
    if most and most * most * len(y) >= EXACT:
        rows = EXACT // (most * most)
        if rows < 1:
            whole = y.astype(object)
            return whole.T @ whole
        parts = [exact_gram(y[i : i + rows]).astype(object) for i in range(0, len(y), rows)]
        return sum(parts[1:], parts[0])
    double = y.astype(np.float64)
    return (double.T @ double).astype(np.int64)


def _collected(cells: DataFrame) -> list[int]:
    """The grand total of each cell; their number depends on the width of the vectors only."""
    found = cells.groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("cell").collect()
    return [(int(r["high"]) << PART) + int(r["low"]) for r in found]


# --- spectrum of one symmetric matrix


def above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above `shift`: positive pivots of LDL^T of the shifted matrix.

    Symmetric pivoting with blocks of one and two rows (Bunch and Kaufman)
    keeps the factors bounded. A pivot of zero counts as not above.
    """
    a = matrix - shift * np.eye(len(matrix))
    alpha, found, k, n = (1 + 17**0.5) / 8, 0, 0, len(a)

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        column = np.abs(a[k + 1 :, k])
        size = 1
        if len(column) and column.max() > 0:
            r = k + 1 + int(column.argmax())
            most = column.max()
            if abs(a[k, k]) < alpha * most:
                row = np.abs(a[k:, r])
                row[r - k] = 0.0
                widest = row.max()
                if abs(a[k, k]) * widest >= alpha * most * most:
                    pass
                elif abs(a[r, r]) >= alpha * widest:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        if size == 1:
            pivot = a[k, k]
            found += pivot > 0
            if pivot != 0:
                c = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(c, c / pivot)
        else:
            block, c = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            determinant = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            found += 1 if determinant < 0 else 2 * (block[0, 0] + block[1, 1] > 0)
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(block, c.T)
        k += size
    return int(found)


def _solved(matrix: np.ndarray, shift: float, v: np.ndarray) -> np.ndarray:
    """A multiple of (matrix - shift)^-1 v; a shift that is an eigenvalue to the last bit is moved by a few."""
    size = max(float(np.abs(matrix).max()), 1e-300)
    for nudge in (0.0, 1.0, -1.0, 3.0, 9.0):
        try:
            w = np.linalg.solve(matrix - (shift + nudge * EPS * size) * np.eye(len(matrix)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(w).all() and np.abs(w).max() > 0:
            return w / np.abs(w).max()
    return v


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and their unit eigenvectors as columns.

    Eigenvalues that agree to working precision get some orthonormal basis of
    their common space. The largest entry of each vector is positive.
    """
    n = len(matrix)
    count = min(count, n)
    reach = float(np.abs(matrix).sum(axis=1).max(initial=0.0)) * (1 + 8 * EPS) + 1e-300
    known = {-reach: n, reach: 0}
    tiny = 4 * n * EPS * reach
    draw = np.random.default_rng(7)

    def bracket(k: int, narrow: float) -> tuple[float, float]:
        """Shifts with at least k and fewer than k eigenvalues above them, isolating one or at most `narrow` apart."""
        low = max(s for s, c in known.items() if c >= k)
        high = min(s for s, c in known.items() if c < k and s > low)
        while high - low > narrow and (known[low] > k or known[high] < k - 1):
            middle = (low + high) / 2
            if not low < middle < high:
                break
            known[middle] = above(matrix, middle)
            if known[middle] >= k:
                low = middle
            else:
                high = middle
        return low, high

    values, vectors = [], np.zeros((n, 0))
    for k in range(1, count + 1):
        low, high = bracket(k, tiny)
        for _ in range(80):
            v = draw.standard_normal(n)
            shift, value = (low + high) / 2, None
            for step in range(40):
                v = v - vectors @ (vectors.T @ v)
                v /= np.linalg.norm(v)
                w = _solved(matrix, shift, v)
                w = w - vectors @ (vectors.T @ w)
                w = w - vectors @ (vectors.T @ w)
                w /= np.linalg.norm(w)
                value = float(w @ (matrix @ w))
                rest = float(np.linalg.norm(matrix @ w - value * w))
                v = w
                if rest <= tiny:
                    break
                shift = value if step else shift  # one step at the middle of the bracket, then its quotient
            edge = max(2 * rest, tiny)
            if low - edge <= value <= high + edge and _numbered(matrix, value, edge, k, known):
                break
            # another eigenvalue drew the iteration away, or the bracket is wide: halve it and start again
            middle = (low + high) / 2
            known[middle] = above(matrix, middle)
            low, high = (middle, high) if known[middle] >= k else (low, middle)
        else:
            raise ArithmeticError(f"eigenvalue {k} of {n} was not found")
        values.append(value)
        vectors = np.column_stack([vectors, v * np.sign(v[np.abs(v).argmax()])])
    return np.array(values), vectors


def _numbered(matrix: np.ndarray, value: float, edge: float, k: int, known: dict[float, int]) -> bool:
    """Whether counts just below and above `value` say that it is the k-th largest eigenvalue."""
    known[value - edge], known[value + edge] = above(matrix, value - edge), above(matrix, value + edge)
    return known[value + edge] < k <= known[value - edge]


# --- the operator


@dataclass(frozen=True)
class Whitening:
    """Exact statistics of the fit list and the leading components (columns of `vectors`)."""

    n: int
    width: int
    pivot: np.ndarray  #: whole numbers next to the means
    excess: np.ndarray  #: n * mean - n * pivot, exact
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.pivot).astype(np.float64) - (self.excess / self.n).astype(np.float64)
        return (centred @ self.vectors) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - S)^2 in whole numbers; null beyond 64 bits."""
        y = x - self.pivot
        most = self.n * int(np.abs(y).max(initial=0)) + int(max(map(abs, self.excess), default=0))
        kind = np.int64 if most * most * max(1, self.width) < 1 << 63 else object
        z = y.astype(kind) * self.n - self.excess.astype(kind)
        return [d if d < 1 << 63 else None for d in map(int, (z * z).sum(axis=1))]


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """Statistics and components of the distinct vectors of `rows (x)`; None without any component.

    Vectors shorter than the longest take no part. Components whose eigenvalue
    is zero to working precision are not numbered, so a fit list of m vectors
    has at most m - 1 of them.
    """
    distinct = staged(rows.select("x").distinct(), "whitening-fit")
    width = distinct.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return None
    listed = distinct.filter(F.size("x") == width)
    *sums, n = _collected(listed.mapInArrow(_sums(width), CELLS))
    pivot = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    excess = np.array([s - n * int(p) for s, p in zip(sums, pivot, strict=True)], dtype=object)
    products = _collected(listed.mapInArrow(_products(width, pivot), CELLS))
    covariance = np.zeros((width, width))
    for i, j, p in zip(*np.triu_indices(width), products, strict=True):
        covariance[i, j] = covariance[j, i] = (n * p - excess[i] * excess[j]) / (n * n)
    trace = float(np.trace(covariance))
    size = min(components, above(covariance, 16 * width * EPS * trace)) if trace > 0 else 0
    if not size:
        return None
    values, vectors = leading(covariance, size)
    model = Whitening(n, width, pivot, excess, trace, values, vectors)
    return Whitening(n, width, pivot, excess, trace, values, vectors, _identity_error(listed, model))


def _identity_error(listed: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, measured on its rows."""
    size = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            w = model.project(_rows(batch.column(0), model.width))
            total[:size] += w.T @ w
            total[size] += w.sum(axis=0)
        cells = pa.array(np.arange(total.size, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([cells, pa.array(total.ravel())], ["cell", "total"])

    cells = listed.mapInArrow(run, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    total = np.array([r["total"] for r in cells.orderBy("cell").collect()]).reshape(size + 1, size) / model.n
    return float(np.abs(total[:size] - np.outer(total[size], total[size]) - np.eye(size)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`vec_id, component, n, deviation, whitened, explained, identity_error` per sound row and component.

    The fit list has each distinct vector once, so copies have no weight in it,
    but every row, repeated ones and those with a null key too, is returned.
    Vectors shorter than the longest are left out like unsound ones. There are
    fewer components where the covariance has fewer eigenvalues above zero, and
    no rows at all where it has none (an empty table, one distinct vector).
    `deviation` is null where it exceeds 64 bits. Other columns are not read.
    """
    rows = integer_vectors(vectors, key, vector)
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    size = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            x = _rows(batch.column(1), model.width)
            repeated = np.repeat(np.arange(m), size)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()).take(pa.array(repeated)),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), m)),
                pa.array(np.full(m * size, model.n)),
                pa.array(model.deviation(x), type=pa.int64()).take(pa.array(repeated)),
                pa.array(model.project(x).ravel()),
                pa.array(np.tile(model.explained, m)),
                pa.array(np.full(m * size, model.identity_error)),
            ], [f.split(" ")[0] for f in RESULT.split(", ")])

    return rows.filter(F.size("x") == model.width).mapInArrow(run, RESULT)
