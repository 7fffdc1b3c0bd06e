"""Whitening of embeddings by a cyclic Jacobi eigenvalue method.

Entries become integers, so that the sums (first pass) and the scatter about the nearest whole mean (second pass,
centred before multiplying) are exact whatever the order; what the whole mean is off by is taken out in whole numbers
too, and the covariance is rounded once. The driver turns the symmetric matrix by rotations, sweep by sweep, until
every off-diagonal entry is nothing beside its two diagonal ones, which keeps small eigenvalues accurate. The sorted
matrix goes to the workers (dimensions x components doubles); a third pass measures the covariance of what comes out.
Passes read the table again instead of keeping it: they must see the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import frugal

SCALE, SHIFT = 1024.0, 100_000
#: Entries beyond this count as not finite: their integers would not fit. Whole numbers below EXACT are exact as doubles.
LARGEST, EXACT = 2.0**45, 2.0**53
#: Dimensions that the driver's matrix may have (32 MB), values that a worker holds at once, and sweeps at most.
DIMENSIONS, VALUES, SWEEPS = 2048, 1 << 21, 60
#: An eigenvalue under this part of the largest, a dimension, is nothing: vectors do not vary along it.
NOTHING = 4 * np.finfo(float).eps
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Whitening(NamedTuple):
    """What the fit gives: row count, exact sums, eigenvalues and unit eigenvectors (columns) by falling eigenvalue, and the check's value."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None


def usable(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Which vectors are there with finite entries only."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    flat = lists.flatten()
    values = np.asarray(pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False))
    bad = np.zeros(len(lengths), dtype=np.int64)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    np.add.at(bad, rows, ~(np.abs(values) <= LARGEST))
    return np.asarray(pc.is_valid(lists)) & (bad == 0)


def whole_vectors(column: pa.Array, width: int) -> np.ndarray:
    """The vectors (all usable) as integers; shorter ones are filled up with zeros."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * out).astype(np.int64) + SHIFT


def lots(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer vectors of the usable rows, at most ``VALUES`` values at once."""
    for batch in batches:
        step = max(1, VALUES // max(width, 1))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            part = part.filter(pa.array(usable(part.column("embedding"))))
            if part.num_rows:
                yield part.column("vec_id").cast(pa.int64()), whole_vectors(part.column("embedding"), width)


def exact_product(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` in whole numbers, as Python's where doubles could round."""
    most = float(np.abs(y).max(initial=0))
    if most * most * max(len(y), 1) < EXACT:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def exact_sums(x: np.ndarray) -> np.ndarray:
    """The sum of every column and the number of rows, in whole numbers."""
    small = float(np.abs(x).max(initial=0)) * len(x) < EXACT
    return np.append((x if small else x.astype(object)).sum(axis=0).astype(object), len(x))


def summed(vectors: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray]) -> dict[int, int]:
    """The sum over all rows of what ``work`` gives for a lot, by place; a task sends one row a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in lots(batches, width):
            here = work(x)
            total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["place", "value"])

    partial = vectors.mapInArrow(frugal(run), "place long, value decimal(38,0)")
    return {r.place: int(r.value) for r in partial.groupBy("place").agg(F.sum("value").alias("value")).collect()}


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, by cyclic rotations."""
    a, n = matrix.astype(np.float64).copy(), len(matrix)
    v, eps = np.eye(n), np.finfo(float).eps
    floor = eps * eps * max(float(np.abs(a).max(initial=0)), np.finfo(float).tiny)
    for _ in range(SWEEPS):
        turned = False
        for p in range(n - 1):
            for q in range(p + 1, n):
                off = a[p, q]
                if abs(off) <= max(eps * math.sqrt(abs(a[p, p] * a[q, q])), floor):
                    continue
                turned = True
                ratio = (a[q, q] - a[p, p]) / (2 * off)
                t = math.copysign(1.0, ratio) / (abs(ratio) + math.hypot(1.0, ratio))
                c = 1 / math.hypot(1.0, t)
                s = t * c
                app, aqq = a[p, p] - t * off, a[q, q] + t * off
                row_p, row_q = c * a[p] - s * a[q], s * a[p] + c * a[q]
                a[p], a[q] = row_p, row_q
                a[:, p], a[:, q] = row_p, row_q
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def projector(n: int, sums: list[int], eigenvalues: np.ndarray, vectors: np.ndarray, components: int) -> Callable[[np.ndarray], np.ndarray]:
    """From integer vectors to whitened ones: whole mean off first, then what is left of it; a direction without variance gives NaN."""
    whole = np.array([round(s / n) for s in sums], dtype=np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, whole, strict=True)])
    e = eigenvalues[:components]
    there = e > NOTHING * len(sums) * max(float(eigenvalues.max(initial=0)), 0.0)
    scaled = np.where(there, vectors[:, :components] / np.sqrt(np.where(there, e, 1.0)), np.nan)
    return lambda x: ((x - whole).astype(np.float64) - rest) @ scaled


def fit_whitening(embeddings: DataFrame, components: int = 8) -> Whitening:
    """Mean, covariance and its eigenvectors over all usable rows of ``embeddings``."""
    vectors = embeddings.select("vec_id", "embedding")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    if width > DIMENSIONS:
        raise ValueError(f"vectors of {width} entries; the driver's matrix holds {DIMENSIONS}")
    found = summed(vectors, width, exact_sums)
    n, sums = found.get(width, 0), [found.get(i, 0) for i in range(width)]
    if not n or width <= 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((max(width, 0), 0)), 0.0, None)
    whole = np.array([round(s / n) for s in sums], dtype=np.int64)
    upper = np.triu_indices(width)
    scatter = summed(vectors, width, lambda x: exact_product(x - whole)[upper])
    rest = [s - n * int(m) for s, m in zip(sums, whole, strict=True)]
    covariance = np.zeros((width, width))
    for place, (i, j) in enumerate(zip(*upper, strict=True)):
        # Whole numbers of any size; one rounding, in the division.
        covariance[i, j] = covariance[j, i] = (n * scatter[place] - rest[i] * rest[j]) / (n * n)
    eigenvalues, turned = jacobi(covariance)
    fit = Whitening(n, sums, eigenvalues, turned, float(np.trace(covariance)), None)
    return fit._replace(identity_error=identity_error(vectors, fit, components))


def identity_error(vectors: DataFrame, fit: Whitening, components: int) -> float | None:
    """The largest entry by which the covariance of the whitened rows differs from the identity, measured over all rows."""
    k, width = min(components, len(fit.sums)), len(fit.sums)
    shared = vectors.sparkSession.sparkContext.broadcast((fit.n, fit.sums, fit.eigenvalues, fit.vectors, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        white, total = projector(*shared.value), np.zeros((k + 1, k))
        for _, x in lots(batches, width):
            w = white(x)
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "value"])

    rows = vectors.mapInArrow(frugal(run), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    total = np.array([r.value for r in sorted(rows, key=lambda r: r.place)]).reshape(k + 1, k) / fit.n
    # The rows are centred already; what rounding left of their mean goes too.
    off = np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k))
    return None if np.isnan(off).all() else float(np.nanmax(off))


def whitened(embeddings: DataFrame, fit: Whitening, components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable row and component.

    Rows whose vector is null or holds null, infinite or NaN entries (or such beyond 2^45) are left out. Vectors that
    are shorter than the longest count as filled up with zeros. There are as many components as dimensions, eight at
    most. Where vectors do not vary along a component (one row, equal rows, fewer rows than dimensions) ``whitened`` is
    null, and ``explained`` is null where nothing varies at all; ``deviation`` is null where it exceeds a long. Repeated
    rows and null ids are rows like others, and an empty table gives no rows.
    """
    k, width = min(components, len(fit.eigenvalues)), len(fit.sums)
    shared = embeddings.sparkSession.sparkContext.broadcast((fit.n, fit.sums, fit.eigenvalues, fit.vectors, k))
    trace, error = fit.trace, fit.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, eigenvalues, _, k = shared.value
        white = projector(*shared.value) if n else None
        for ids, x in lots(batches, width):
            rows = len(ids)
            out = white(x)
            explained = np.tile(eigenvalues[:k] / trace, rows) if trace > 0 else np.full(rows * k, np.nan)
            deviation = deviations(x, n, sums)
            columns = [
                ids.take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(out.ravel(), from_pandas=True),
                pa.array(explained, from_pandas=True),
                pa.array([error] * (rows * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    return embeddings.select("vec_id", "embedding").mapInArrow(frugal(run), SCHEMA)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2, exact; null beyond a long."""
    s = np.array(sums, dtype=object)
    most = max([abs(int(v)) for v in (x.max(initial=0), x.min(initial=0))]) * n + max((abs(v) for v in sums), default=0)
    if most < 2**62:
        d = n * x - s.astype(np.int64)
        largest = int(np.abs(d).max(initial=0))
        if largest * largest * max(len(sums), 1) < 2**63:
            return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(v) - t) ** 2 for v, t in zip(row, sums, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in exact]
