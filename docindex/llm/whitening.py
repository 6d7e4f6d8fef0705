"""Embedding whitening by shifted CholeskyQR: distributed Gram passes repeatedly orthogonalise the centred rows through triangular
solves; the composed R factors then give the whitening components by the SVD of one small matrix.

1. Each component c becomes the whole number floor(256 c). The fit list holds each distinct vector once (Y: its rows, centred);
   its size n and its sums S are exact, whatever their size.
2. A pass sums the Gram matrix of Q = Y / R_1 / R_2 ... (triangular solves, row by row) in the tasks, one matrix each, which are
   put together in order of the tasks: reruns over the same table give the same bits. The driver gets at most GROUPS matrices of
   one row a dimension each. The Gram matrix's Cholesky factor is the next R; the first one is shifted, so that it exists
   whatever the condition of Y, and so are later ones while the Gram matrix is nearly singular. A few passes make Q orthonormal
   to rounding.
3. With Q'Q = E diag(l) E' and R = ... R_2 R_1, the matrix diag(sqrt(l)) E' R has the singular values and right singular vectors of
   Y: the square roots of n times the covariance's eigenvalues, and its eigenvectors. What is not orthonormal yet, as where Y has
   less than full rank, is thus accounted for exactly.
4. A last pass measures the covariance of the whitened fit list.

Defined results: vectors that are null, hold null or non-finite components, or are of another length than most take no part;
components that don't fit in 64 bits become the nearest number that does; a deviation that doesn't fit is null; directions
whose standard deviation is below NOTHING of the largest one's are rounding and are left out, so vectors that are all equal, and an
empty table, give no rows; repeated rows and null or repeated vec_ids are rows like others; other columns are ignored, whatever
their names. Eigenvectors have their largest entry positive; those of equal eigenvalues are any base of their space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import as_numbers, finite, unpacked

COMPONENTS = 4
#: Passes at most; they end when Q is orthonormal to within TIGHT.
PASSES, TIGHT = 5, 1e-12
#: Matrices that the driver adds up; those of the tasks are added into so many first.
GROUPS = 64
#: Rows that a task multiplies at once.
ROWS = 2048
NOTHING = 1e-12


@dataclass
class Whitening:
    """n, exact sums, mean, axes (a column for each component), the components' eigenvalues, the trace of the covariance, and the
    largest entry of the whitened covariance minus the identity."""

    n: int
    sums: list[int]
    mean: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float
    error: float


def solved(y: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """y / factor for an upper triangular factor, by forward substitution over its columns."""
    out = np.empty_like(y)
    for j in range(y.shape[1]):
        out[:, j] = (y[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def sums_of(fit_list: DataFrame, length: int) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension. Sums travel in two halves, so that they can't overflow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(length, np.int64), np.zeros(length, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = unpacked(b.column("x").slice(at, ROWS), length)
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([*range(-1, length)], pa.int32()), pa.array([0, *high.tolist()], pa.int64()), pa.array([n, *low.tolist()], pa.int64())], ["dimension", "high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    rows = fit_list.mapInArrow(work, "dimension int, high long, low long").groupBy("dimension").agg(whole("high").alias("high"), whole("low").alias("low")).collect()
    found = {r["dimension"]: (int(r["high"]) << 32) + int(r["low"]) for r in rows}
    return found.get(-1, 0), [found.get(j, 0) for j in range(length)]


def gram(fit_list: DataFrame, length: int, turned: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the rows, sum of their products) of turned(x) over the fit list."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = 0.0, 0.0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                y = turned(unpacked(b.column("x").slice(at, ROWS), length))
                total, products = total + y.sum(axis=0), products + y.T @ y
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())], ["part", "total", "products"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        both = [sum(np.frombuffer(x) for x in rows[c]).tobytes() for c in ("total", "products")]
        return pd.DataFrame({"part": rows["part"].iloc[:1], "total": both[:1], "products": both[1:]})

    schema = "part long, total binary, products binary"
    parts = fit_list.mapInArrow(work, schema)
    found = sorted(parts.groupBy(F.pmod("part", F.lit(GROUPS))).applyInPandas(added, schema).collect(), key=lambda r: r["part"])
    if not found:
        return np.zeros(length), np.zeros((length, length))
    total, products = (sum(np.frombuffer(r[c]) for r in found) for c in ("total", "products"))
    return total, products.reshape(len(total), -1)


def fit(fit_list: DataFrame, length: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a table of distinct vectors (x: packed(), `length` numbers each)."""
    n, sums = sums_of(fit_list, length)
    mean = np.array([s / n for s in sums]) if n else np.zeros(length)
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        y = x - mean
        for factor in factors:
            y = solved(y, factor)
        return y

    rest = np.zeros(length)
    values = np.zeros(1)
    for step in range(PASSES if length else 0):
        total, products = gram(fit_list, length, orthogonal)
        if not step:
            rest = total / max(n, 1)  # what rounding left of the mean
        products = (products + products.T) / 2
        values, vectors = np.linalg.eigh(products)
        if values[-1] <= 0 or step and np.abs(values - 1).max() <= TIGHT or step == PASSES - 1:
            break
        shift = min(11.0 * (n * length + length * (length + 1)) * 2.0**-53, 1e-3) * values[-1]
        shifted = not step or values[0] <= shift
        factors.append(np.linalg.cholesky(products + shift * shifted * np.eye(length)).T)
    if values[-1] <= 0:
        return Whitening(n, sums, mean, np.zeros((length, 0)), np.zeros(0), 0.0, 0.0)
    small = np.eye(length)
    for factor in factors:
        small = factor @ small
    _, singular, right = np.linalg.svd(np.sqrt(np.maximum(values, 0))[:, None] * (vectors.T @ small))
    kept = int((singular[:components] > NOTHING * singular[0]).sum())
    axes, eigenvalues = right[:kept].T.copy(), singular[:kept] ** 2 / n
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)])
    out = Whitening(n, sums, mean, axes, eigenvalues, float((singular**2).sum() / n), 0.0)
    _, products = gram(fit_list, length, lambda x: whitened(x - mean - rest, out))
    out.error = float(np.abs(products / n - np.eye(kept)).max())
    return out


def whitened(centred: np.ndarray, w: Whitening) -> np.ndarray:
    return centred @ w.axes / np.sqrt(w.values)


def deviations(x: np.ndarray, w: Whitening) -> list[int | None]:
    """The sum over the dimensions of (n x - S)^2, exactly."""
    largest = w.n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(map(abs, w.sums)) if x.size else 0
    if len(w.sums) * largest**2 < 1 << 63:
        return ((w.n * x - np.array(w.sums, np.int64)) ** 2).sum(axis=1).tolist()
    whole = ((w.n * x.astype(object) - np.array(w.sums, object)) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in whole]


def transform(numbers: DataFrame, w: Whitening) -> DataFrame:
    """vec_id, deviation, whitened (array, one entry a component) of numbers (vec_id, x); a narrow pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = unpacked(b.column("x").slice(at, ROWS), len(w.sums))
                made = [pa.array(deviations(x, w), pa.int64()), pa.array(whitened(x - w.mean, w).tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([b.column("vec_id").slice(at, ROWS), *made], ["vec_id", "deviation", "whitened"])

    return numbers.select("vec_id", "x").mapInArrow(work, "vec_id long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """(transform() of the rows of vectors (vec_id, embedding) that take part, the whitening fitted to their distinct vectors)."""
    rows, length = finite(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    numbers = cut(as_numbers(rows))
    w = fit(cut(numbers.select("x").distinct()), length, components)
    return transform(numbers, w), w
