"""Embedding whitening: principal components by contour integration (FEAST), applied to every row.

Sums and centred second moments are gathered by Spark, one small matrix per task. The eigenproblem of the covariance has
the size of one vector and is solved where the matrix is: inertia counts cut the spectrum into slices, and in each slice a
quadrature of complex shifted solves along a circle projects a few trial vectors onto its eigenvectors. Rayleigh-Ritz
extracts them, and a slice is done when it holds as many components as its inertia says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
#: Entries become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components in a slice of the spectrum, points of the quadrature on half a circle, rounds before the trial space is widened.
SLICE, NODES, ROUNDS = 8, 8, 20
#: Rows of a batch that are held as numbers at a time.
ROWS = 4096


# --- the eigenproblem ---------------------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a matrix similar to the symmetric `v`, by Householder reflections."""
    a = np.array(v, dtype=float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if size == 0:
            continue
        u = x.copy()
        u[0] += np.copysign(size, x[0])
        u /= np.linalg.norm(u)
        a[k + 1 :, k:] -= 2 * np.outer(u, u @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above `shift`: the positive pivots of the factorised shifted matrix (Sylvester's law of inertia)."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot, count = diagonal[0] - shift, 0
    for i in range(len(diagonal)):
        if i:
            pivot = diagonal[i] - shift - off[i - 1] ** 2 / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return int(count)


def _boundary(diagonal: np.ndarray, off: np.ndarray, count: int, low: float, high: float) -> tuple[float, float]:
    """The middle and width of the gap below the `count` largest eigenvalues."""

    def edge(k: int) -> float:  # the largest shift with at least k eigenvalues above it
        a, b = low, high
        for _ in range(100):
            c = (a + b) / 2
            a, b = (c, b) if above(diagonal, off, c) >= k else (a, c)
        return a

    upper, lower = edge(count), edge(count + 1) if above(diagonal, off, low) > count else low
    return (upper + lower) / 2, upper - lower


def _slice(v: np.ndarray, a: float, b: float, count: int, error: float) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenpairs between `a` and `b`."""
    n, middle, radius = len(v), (a + b) / 2, (b - a) / 2
    node, weight = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi * (node + 1) / 2
    width = min(n, count + max(4, count // 2))
    while True:
        y = np.random.default_rng(7).normal(size=(n, width))
        for _ in range(ROUNDS):
            q = np.zeros((n, width))
            for w, t in zip(weight, angle, strict=True):
                turn = np.exp(1j * t)
                q += (w / 2) * np.real(radius * turn * np.linalg.solve((middle + radius * turn) * np.eye(n) - v, y.astype(complex)))
            q = np.linalg.qr(q)[0]
            value, mix = np.linalg.eigh(q.T @ v @ q)
            y = q @ mix
            inside = (value > a) & (value < b)
            wrong = np.linalg.norm(v @ y[:, inside] - y[:, inside] * value[inside], axis=0)
            if inside.sum() == count and (wrong <= error).all():
                return value[inside], y[:, inside]
        if width == n:  # the trial space is the whole space, so these are eigenpairs to rounding
            return value[inside], y[:, inside]
        width = min(n, 2 * width)


def leading(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns; eigenvalues that are zero to rounding are left out."""
    diagonal, off = tridiagonal(v)
    reach = np.abs(diagonal) + np.r_[np.abs(off), 0] + np.r_[0, np.abs(off)]
    scale = float(reach.max()) if len(v) else 0.0
    eps = np.finfo(float).eps
    high, low = scale * (1 + 64 * eps), scale * len(v) * 4 * eps
    rank = above(diagonal, off, low) if scale > 0 else 0
    if not rank:
        return np.zeros(0), np.zeros((len(v), 0))
    done, top, values, vectors = 0, high, [], []
    while done < min(components, rank):
        ends = min(done + SLICE, components, rank)
        bottom, gap = _boundary(diagonal, off, ends, low, high) if ends < rank else (low, scale)
        while ends < rank and gap < 1e-7 * scale:  # never cut between eigenvalues that are nearly equal
            ends += 1
            bottom, gap = _boundary(diagonal, off, ends, low, high) if ends < rank else (low, scale)
        value, vector = _slice(v, bottom, top, ends - done, 64 * eps * scale)
        if len(value) != ends - done:
            raise ArithmeticError(f"{ends - done} components by inertia, {len(value)} found")
        values.append(value)
        vectors.append(vector)
        done, top = ends, bottom
    space = np.linalg.qr(np.concatenate(vectors, axis=1))[0]
    value, mix = np.linalg.eigh(space.T @ v @ space)
    vector = space @ mix[:, ::-1][:, :components]
    sign = np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])
    return value[::-1][:components], vector * sign


# --- the data -----------------------------------------------------------------------------------


def _numbers(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and whole numbers of the rows, a bounded number at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            c = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            yield part.column(0), np.floor(SCALE * c).astype(np.int64) + SHIFT


def _sums(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=np.int64)
        for _, x in _numbers(batches, width):
            n, total = n + len(x), total + x.sum(0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(width), "n": np.full(width, n), "total": total})

    return run


def _products(width: int, shaped: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The upper triangle of the sum of outer products of the shaped (centred) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _numbers(batches, width):
            z = shaped(x)
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "total": total[i, j]})

    return run


def _matrix(rows: DataFrame, width: int, shaped: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    parts = rows.mapInArrow(_products(width, shaped), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    out = np.zeros((size, size))
    for r in parts.collect():  # a cell of a matrix that is as wide as a vector
        out[r.i, r.j] = out[r.j, r.i] = r.total
    return out


@dataclass
class Whitening:
    """n, the rounded mean and what it leaves (sum - n * mean) per dimension, components and their eigenvalues."""

    n: int
    mean: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) - self.rest / self.n) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The exact sum of (n * x - sum)^2; null where 64 bits cannot hold it."""
        y = x - self.mean
        if self.n * (float(np.abs(y).max(initial=0)) + 1) < 2**31 / np.sqrt(max(1, y.shape[1])):
            return pa.array(((self.n * y - self.rest) ** 2).sum(1))
        exact = ((self.n * y.astype(object) - self.rest.astype(object)) ** 2).sum(1).tolist()
        return pa.array([e if e < 2**63 else None for e in exact], pa.int64())


def _rows(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """Rows that take part, and the length of their vectors."""
    vector = F.col("embedding")
    sound = F.size(vector) > 0
    sound = sound & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector).where(vector.isNotNull() & sound)
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    width = sizes["size"] if sizes else 0
    return rows.where(F.size("embedding") == width), width


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """Mean, components and the check of the whitened covariance from all rows; None if there is nothing to whiten."""
    found = rows.mapInArrow(_sums(width), "at long, n long, total long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    sums = {r["at"]: r for r in found.collect()}  # one row per dimension
    n = sums[0]["n"] if sums else 0
    if not n:
        return None
    total = [sums[i]["total"] for i in range(width)]
    mean = np.array([(2 * t + n) // (2 * n) for t in total], dtype=np.int64)
    rest = np.array([t - n * int(m) for t, m in zip(total, mean, strict=True)], dtype=np.int64)
    # Products of whole numbers around the rounded mean are exact in doubles, whatever the order of the sum.
    delta = rest / n
    covariance = _matrix(rows, width, lambda x: (x - mean).astype(float), width) / n - np.outer(delta, delta)
    values, vectors = leading(covariance, components)
    if not len(values):
        return None
    model = Whitening(n, mean, rest, values, vectors, float(np.trace(covariance)), 0.0)
    check = _matrix(rows, width, model.whitened, len(values)) / n
    model.identity_error = float(np.abs(check - np.eye(len(values))).max())
    return model


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _apply(model: Whitening, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for ids, x in _numbers(batches, width):
            each = pa.array(np.repeat(np.arange(len(x)), k))
            size = len(x) * k
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids.take(each),
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                "n": np.full(size, model.n, dtype=np.int64),
                "deviation": model.deviation(x).take(each),
                "whitened": model.whitened(x).ravel(),
                "explained": np.tile(model.values / model.trace, len(x)),
                "identity_error": np.full(size, model.identity_error),
            })

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every row, one row per component.

    Only `vec_id` and `embedding` are read, so other columns may have any name. Null vectors, vectors with null or non-finite
    entries, empty ones, and ones of another length than the most frequent (of those, the longest) take no part. Repeated rows
    count and are returned each; a null vec_id stays null. Components whose eigenvalue is zero to rounding cannot be
    scaled and are left out, so fewer than `components` come back from few, equal or dependent vectors, and an empty or constant
    table gives no rows. A deviation that 64 bits cannot hold is null.
    """
    rows, width = _rows(embeddings)
    model = fit(rows, width, components) if width else None
    if model is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    return rows.mapInArrow(_apply(model, width), RESULT)
