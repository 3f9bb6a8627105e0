"""Embedding whitening by eigenvectors of the distributed covariance.

Each entry c becomes the whole number floor(64 c) + 1,000,000. The fit list holds each different vector once: its
size n and its sums S by dimension are exact, and the covariance V (divisor n) is summed from vectors that are centred
first. Tasks turn their vectors into one matrix of sums each, and these are added up entry by entry, so what is
shuffled and what reaches the driver is bounded by the square of the dimension, never by the rows.

The driver brings V to tridiagonal form by Householder reflections, finds its leading eigenvalues by bisection on
Sturm counts, and their vectors by inverse iteration on the tridiagonal matrix; vectors of eigenvalues that lie
close together are made orthogonal in each iteration. The reflections take them back. Components, means and scales
(again bounded by the dimension) go to the tasks that project all rows.

Defined results: vectors that are null or hold null or non-finite entries take no part, nor do vectors shorter than
the longest, whose missing entries count as null; repeated rows and vectors give their rows again but count once
in the fit; a component without variance (relative eigenvalue of ``NOISE`` or less) can't be whitened and is left
out, so equal vectors alone give an empty result, as does an empty table; entries beyond the range of whole numbers
of 64 bits are cut to it; a deviation beyond that range is null. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_arrow, ready_workers, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues up to this share of the largest are rounding.
NOISE = 1e-12
#: Eigenvalues closer than this share of the matrix's norm form a cluster.
CLUSTER = 1e-3


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal and reflections (first row, unit vector) of a symmetric matrix."""
    a = np.array(matrix, dtype=float)
    reflections = []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            continue
        x[0] += size if x[0] >= 0 else -size
        v = x / np.linalg.norm(x)
        # H A H on the rows and columns from k + 1 on; A stays symmetric.
        part = a[k + 1 :, k:]
        part -= 2 * np.outer(v, v @ part)
        part = a[k:, k + 1 :]
        part -= 2 * np.outer(part @ v, v)
        reflections.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def below(diagonal: np.ndarray, off: np.ndarray, x: float) -> int:
    """How many eigenvalues are smaller than x: negative terms of the Sturm sequence."""
    count, q = 0, 1.0
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    for i, d in enumerate(diagonal):
        q = d - x - (off[i - 1] ** 2 / q if i else 0.0)
        if abs(q) < tiny:
            q = -tiny
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> list[float]:
    """The largest eigenvalues, falling, each bisected until no number lies between its bounds."""
    size = len(diagonal)
    around = np.zeros(size)
    around[:-1] += np.abs(off)
    around[1:] += np.abs(off)
    low, high = float(np.min(diagonal - around)), float(np.max(diagonal + around))
    slack = np.finfo(float).eps * max(abs(low), abs(high), np.finfo(float).tiny) * size
    found, top = [], high + slack
    for number in range(min(wanted, size)):
        a, b = low - slack, top
        while a < (middle := (a + b) / 2) < b:
            a, b = (a, middle) if below(diagonal, off, middle) >= size - number else (middle, b)
        found.append((a + b) / 2)
        top = b
    return found


def tridiagonal_solver(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float):
    """A function that solves (T - shift) x = y, by elimination with row exchanges; a zero pivot counts as ``tiny``."""
    size = len(diagonal)
    u, steps = [], []
    row = [diagonal[0] - shift, off[0] if size > 1 else 0.0, 0.0]
    for i in range(size - 1):
        under = [off[i], diagonal[i + 1] - shift, off[i + 1] if i + 2 < size else 0.0]
        swap = abs(under[0]) > abs(row[0])
        if swap:
            row, under = under, row
        pivot = row[0] if abs(row[0]) > tiny else tiny
        factor = under[0] / pivot
        u.append((pivot, row[1], row[2]))
        steps.append((swap, factor))
        row = [under[1] - factor * row[1], under[2] - factor * row[2], 0.0]
    u.append((row[0] if abs(row[0]) > tiny else tiny, 0.0, 0.0))

    def solve(y: np.ndarray) -> np.ndarray:
        y = y.copy()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor * y[i]
        for i in range(size - 1, -1, -1):
            if i + 1 < size:
                y[i] -= u[i][1] * y[i + 1]
            if i + 2 < size:
                y[i] -= u[i][2] * y[i + 2]
            y[i] /= u[i][0]
        return y

    return solve


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit eigenvectors of a tridiagonal matrix by inverse iteration, one row for each value."""
    size = len(diagonal)
    norm = max(float(np.max(np.abs(diagonal))), float(np.max(np.abs(off))) if size > 1 else 0.0, np.finfo(float).tiny)
    start = np.random.default_rng(1)
    vectors: list[np.ndarray] = []
    cluster = 0
    for number, value in enumerate(values):
        if number and values[number - 1] - value > CLUSTER * norm:
            cluster = number
        # Equal values get their own solutions from their own starts; the pivots' bound keeps them finite.
        solve = tridiagonal_solver(diagonal, off, value, np.finfo(float).eps * norm)
        x = start.standard_normal(size)
        for _ in range(6):
            x = solve(x / np.linalg.norm(x))
            x /= np.max(np.abs(x))
            for _ in range(2):
                for other in vectors[cluster:]:
                    x -= (other @ x) * other
            x /= np.linalg.norm(x)
        vectors.append(x)
    return np.array(vectors)


def principal_components(matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and their unit vectors as rows; those without variance are left out."""
    scale = np.max(np.abs(matrix), initial=0.0)
    if scale == 0:
        return np.empty(0), np.empty((0, len(matrix)))
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, off, wanted)
    values = [v for v in values if v > NOISE * max(values[0], 0.0) and v > 0]
    if not values:
        return np.empty(0), np.empty((0, len(matrix)))
    vectors = eigenvectors(diagonal, off, values)
    for first, v in reversed(reflections):
        vectors[:, first:] -= 2 * np.outer(vectors[:, first:] @ v, v)
    return np.array(values) * scale, vectors


@dataclass(frozen=True)
class Whitening:
    """What the fit found; its size is bounded by the dimension."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    total: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; as whole numbers of any size where 64 bits may not do."""
        reach = self.n * int(max(np.max(x), -np.min(x), 1)) + max(map(abs, self.sums))
        if reach < 2**62:
            apart = x * self.n - np.array(self.sums, dtype=np.int64)
            if len(self.sums) * int(np.max(np.abs(apart))) ** 2 < 2**63:
                return (apart * apart).sum(axis=1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums)) for row in x]
        return [d if d < 2**63 else None for d in exact]


def whole_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with complete vectors, these as whole numbers ``x``."""
    entry = F.col(f"`{vector}`")
    odd = F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(entry, lambda c: F.least(F.floor(c.cast("double") * SCALE), F.lit(2**63 - 1 - SHIFT)) + SHIFT)
    return vectors.where(entry.isNotNull()).where(~odd).withColumn("x", x)


def matrix_of(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of an Arrow column as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), size)


def summed_outer(fit: DataFrame, size: int, centred) -> np.ndarray:
    """The sum of v v' over the fit list, where ``centred`` turns its vectors into rows v.

    Each task gives the rows of one matrix; these are added up entry by entry on the cluster.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                v = centred(matrix_of(batch.column(0), size))
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            rows = pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(list(rows), names=["i", "parts"])

    ready_workers(fit.sparkSession)
    parts = fit.select("x").mapInArrow(task, "i int, parts array<double>").select("i", F.posexplode("parts").alias("j", "part"))
    entries = parts.where("j >= i").groupBy("i", "j").agg(F.sum("part").alias("part")).collect()
    width = 1 + max((r["i"] for r in entries), default=-1)
    matrix = np.zeros((width, width))
    for r in entries:
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["part"]
    return matrix


def fit_list(whole: DataFrame) -> tuple[DataFrame, int]:
    """Each different vector once, and the dimension; shorter vectors are left out."""
    fit = written(whole.select("x").distinct(), "fit")
    size = fit.agg(F.max(F.size("x"))).first()[0] or 0
    return fit.where(F.size("x") == size), size


def fitted_whitening(fit: DataFrame, size: int) -> Whitening | None:
    """Mean, components and eigenvalues of the fit list; None if there is nothing to whiten."""
    if not size:
        return None
    # Sums as decimals can't overflow; one row of them for each dimension.
    sums = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).collect()
    n = sums[0]["n"]
    by_place = [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])]
    mean = np.array([s / n for s in by_place])
    covariance = summed_outer(fit, size, lambda x: x - mean) / n
    values, vectors = principal_components(covariance)
    return Whitening(n, by_place, values, vectors, float(np.trace(covariance))) if len(values) else None


def identity_error(fit: DataFrame, size: int, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance minus the identity, from a pass over it."""
    covariance = summed_outer(fit, size, model.whitened) / model.n
    return float(np.max(np.abs(covariance - np.eye(len(covariance)))))


def whiten(whole: DataFrame, model: Whitening, row_id: str = "vec_id") -> DataFrame:
    """The whitened vector of each row of ``whole_vectors`` (row_id, deviation, whitened)."""
    kind = whole.schema[row_id].dataType.simpleString()
    size = len(model.sums)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(1), size)
                columns = [batch.column(0), pa.array(model.deviations(x), pa.int64()), pa.array(model.whitened(x).tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[row_id, "deviation", "whitened"])

    rows = whole.where(F.size("x") == size).select(row_id, "x")
    return map_arrow(rows, task, f"`{row_id}` {kind}, deviation bigint, whitened array<double>")


def whitening_report(vectors: DataFrame) -> DataFrame:
    """Each row's whitened components, with the figures of the fit."""
    whole = whole_vectors(vectors.select("vec_id", "embedding"))
    fit, size = fit_list(whole)
    model = fitted_whitening(fit, size)
    if model is None:
        schema = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], f"vec_id {whole.schema['vec_id'].dataType.simpleString()}, {schema}")
    error = identity_error(fit, size, model)
    explained = F.array(*[F.lit(float(v / model.total)) for v in model.values])
    rows = whiten(whole, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
