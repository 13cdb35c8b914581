"""Whitening of vectors by a cyclic Jacobi eigendecomposition of their covariance.

Entries are put on a grid of integers, so that counts and sums are exact. The scatter around the mean is summed in the tasks
(entries centred before they are multiplied) and reduced by Spark to one row a cell; the driver holds one square
matrix of the dimension and turns it by symmetric Jacobi rotations until its off-diagonals vanish beside their own diagonals, which keeps
small eigenvalues accurate. The whitening matrix, dimension times components, is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import small

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Entries from here on have no exact place on the grid.
LARGEST = 2.0**40
_LONG = (1 << 63) - 1


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix. A sweep turns every pair of places once, in
    rounds of disjoint pairs; it ends when each off-diagonal is below rounding beside the geometric mean of its two diagonals.
    The largest entry of a vector (the first of equals) is positive. Raises if ``sweeps`` don't settle."""
    a = np.array(matrix, np.float64)
    d = len(a)
    v = np.eye(d)
    ring = np.arange(d + d % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[: len(ring) // 2 - 1 : -1]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            real = np.maximum(p, q) < d
            p, q = p[real], q[real]
            off = a[p, q]
            big = np.abs(off) > 2.0**-53 * np.sqrt(np.abs(a[p, p] * a[q, q]))
            if not big.any():
                continue
            turned = True
            p, q, off = p[big], q[big], off[big]
            with np.errstate(over="ignore"):
                tau = (a[q, q] - a[p, p]) / (2.0 * off)
                t = np.where(tau < 0, -1.0, 1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1.0 / np.sqrt(1.0 + t * t)
            s = t * c
            low, high = a[p, p] - t * off, a[q, q] + t * off
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = low, high
            v[:, p], v[:, q] = c * v[:, p] - s * v[:, q], s * v[:, p] + c * v[:, q]
        if not turned:
            break
    else:
        raise RuntimeError(f"rotations did not settle within {sweeps} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    v /= np.linalg.norm(v, axis=0)
    v *= np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return np.diag(a)[order], v


@dataclass
class Whitening:
    """``n`` vectors with per-dimension sums ``total``; ``values`` and ``vectors`` (columns) of the covariance's leading components, ``trace`` of the covariance.
    A component whose eigenvalue is zero to rounding has no whitened value."""

    n: int
    total: list[int]
    largest: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int
    offset: int

    @property
    def usable(self) -> np.ndarray:
        return self.values > 4 * len(self.total) * np.finfo(np.float64).eps * max(self.values.max(initial=0.0), 0.0)

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors[:, self.usable] / np.sqrt(self.values[self.usable])


def grid(batch: pa.RecordBatch, scale: int, offset: int) -> np.ndarray:
    """Rows of integers floor(scale * entry) + offset."""
    column = batch.column("v")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * scale).astype(np.int64) + offset).reshape(batch.num_rows, -1)


def centred(x: np.ndarray, n: int, total: list[int], largest: int) -> np.ndarray:
    """n * x - total, exact: longs where the bound on the entries proves that they hold it, else Python integers."""
    if n * largest * 2 <= _LONG:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def deviations(y: np.ndarray) -> list[int | None]:
    """Sums of squares of integers; null where a long doesn't hold one."""
    if y.size and y.dtype != object and int(np.abs(y).max()) <= isqrt(_LONG // y.shape[1]):
        return (y * y).sum(axis=1).tolist()
    return [s if s <= _LONG else None for s in (sum(int(e) ** 2 for e in row) for row in y)]


def usable_rows(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """Rows (vec_id, v) that take part, and their dimension (0: none). Vectors that are null, empty, or hold null or non-finite entries or ones of 2^40 or more don't; nor do vectors whose
    length isn't the commonest (ties: the longer)."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST)) & (F.size("v") > 0))
    first = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.where(F.size("v") == first.d), first.d) if first else (rows, 0)


def _gram(rows: DataFrame, project: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """Sum of the products of every two columns of what ``project`` makes of the rows: a matrix in each task, its upper half added up by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for batch in small(batches):
            z, seen = project(batch), True
            total += z.T @ z
        if seen:
            at = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array((at[0] * width + at[1]).astype(np.int64)), pa.array(total[at])], names=["cell", "value"])

    got = rows.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width * width)
    out[got["cell"].to_numpy()] = got["value"].to_numpy()
    out = out.reshape(width, width)
    return out + np.triu(out, 1).T


def fit(rows: DataFrame, d: int, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> Whitening:
    """The whitening of rows (vec_id, v) of dimension ``d``, fitted on all of them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, largest = 0, [0] * d, 0
        for batch in small(batches):
            x = grid(batch, scale, offset)
            if len(x):
                n, largest = n + len(x), max(largest, int(np.abs(x).max()))
                total = [t + int(s) for t, s in zip(total, x.sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(list(map(str, total))), pa.array([largest] * d, pa.int64())], names=["at", "n", "total", "largest"])

    parts = rows.mapInArrow(sums, "at int, n long, total string, largest long")
    found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.max("largest").alias("largest")).orderBy("at").collect()
    n, total, largest = int(found[0].n), [int(r.total) for r in found], int(found[0].largest)
    cov = _gram(rows, lambda b: centred(grid(b, scale, offset), n, total, largest).astype(np.float64) / n, d) / n
    values, vectors = jacobi(cov)
    k = min(components, d)
    return Whitening(n, total, largest, values[:k], vectors[:, :k], float(np.trace(cov)), scale, offset)


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """One row for each row (vec_id, v) and component. identity_error is measured on the whitened rows themselves, in a pass before."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    used = int(model.usable.sum())

    def exact(m: Whitening, batch: pa.RecordBatch) -> np.ndarray:
        return centred(grid(batch, m.scale, m.offset), m.n, m.total, m.largest)

    def whitened(batch: pa.RecordBatch) -> np.ndarray:
        # the last column counts: sums of the whitened columns come with their products
        m = shipped.value
        w = (exact(m, batch).astype(np.float64) / m.n) @ m.matrix
        return np.hstack([w, np.ones((len(w), 1))])

    gram = _gram(rows, whitened, used + 1) / model.n
    # the mean of the centred vectors is zero but for rounding; taking it off again centres exactly
    spread = gram[:-1, :-1] - np.outer(gram[:-1, -1], gram[:-1, -1])
    error = float(np.abs(spread - np.eye(used)).max(initial=0.0))
    k = len(model.values)
    explained = np.where(model.usable, model.values / model.trace if model.trace else 0.0, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in small(batches, 1 << 20):
            y = exact(m, batch)
            w = np.full((len(y), k), np.nan)
            w[:, m.usable] = (y.astype(np.float64) / m.n) @ m.matrix
            rows_of = np.repeat(np.arange(len(y)), k)
            flat = w.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(len(flat), m.n, np.int64)),
                    pa.array(deviations(y), pa.int64()).take(pa.array(rows_of)), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, len(y))), pa.array(np.full(len(flat), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, SCHEMA)


def whiten(vectors: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row of ``vectors`` that takes part (see ``usable_rows``) and each of the
    ``components`` leading components (fewer if the dimension is less).

    Null and repeated ids stay, a row each; all rows are fitted and counted. Components of equal eigenvalue are numbered by their place in the matrix. A component
    without spread (equal vectors, repeated dimensions, one row) has explained 0 and whitened null. A deviation beyond a long is null. No usable row gives no rows. Other columns aren't read."""
    rows, d = usable_rows(vectors, key, vector)
    if not d:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    return transform(rows, fit(rows, d, components))
