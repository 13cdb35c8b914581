"""Vectors of texts: a truncated singular value decomposition of hashed term weights.

A text is a unit vector over ``SLOTS`` hashed terms, log-damped counts times inverse document frequency. The decomposition finds the
leading right singular vectors by a randomized range finder with power rounds. A round is one pass over the sparse rows
against a broadcast basis (slots times width, whatever the corpus); the tasks' products are added up by slot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.sources.scratch import materialize

SLOTS = 1 << 15
_STEP = 1 << 14


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(s.values.to_numpy() if s.is_valid else np.empty(0, np.int32), return_counts=True) for s in batch.column("slots")]
        columns = [batch.column("key"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "slots", "counts"])


def slot_counts(docs: DataFrame, terms: Column, key: str = "review_id") -> DataFrame:
    """(key, slots, counts): distinct hashed terms of each row and how often it has them; empty for null texts. Written once, as every pass reads it."""
    hashed = F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(SLOTS)).cast("int"))
    return materialize(docs.select(F.col(key).alias("key"), hashed.alias("slots")).mapInArrow(_counted, f"key {dict(docs.dtypes)[key]}, slots array<int>, counts array<int>"))


@dataclass
class Projection:
    """``idf`` of each slot (0: too rare), ``basis``: slots times components, ``values``: singular values."""

    idf: np.ndarray
    basis: np.ndarray
    values: np.ndarray


def weighted_rows(batch: pa.RecordBatch, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the batch, slot, weight) of about _STEP entries at a time, whole rows; each row's weights have length 1 unless all are 0."""
    lengths = batch.column("slots").value_lengths().to_numpy()
    slots, counts = batch.column("slots").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        low = ends[at] - lengths[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + _STEP, "right")))
        row = np.repeat(np.arange(at, stop), lengths[at:stop])
        slot = slots[low : ends[stop - 1]]
        weight = (1.0 + np.log(counts[low : ends[stop - 1]])) * idf[slot]
        size = np.sqrt(np.bincount(row - at, weight * weight, stop - at))
        yield row, slot, weight / np.where(size > 0, size, 1.0)[row - at]
        at = stop


def times(row: np.ndarray, slot: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have an entry, their products with ``basis``)."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    out = np.empty((len(first), basis.shape[1]))
    for i, (low, high) in enumerate(zip(first.tolist(), [*first[1:].tolist(), len(row)])):
        out[i] = weight[low:high] @ basis.take(slot[low:high], axis=0)
    return row[first], out


def _pass(rows: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis, A the weighted rows: slots times width."""
    shipped, width = rows.sparkSession.sparkContext.broadcast((idf, basis)), basis.shape[1]

    def emit(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, SLOTS, 2048):
            own = np.flatnonzero(total[at : at + 2048].any(axis=1)) + at
            if len(own):
                values = pa.FixedSizeListArray.from_arrays(pa.array(total[own].ravel()), width).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), values], names=["slot", "z"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, b = shipped.value
        total = np.zeros((SLOTS, width))
        one, two = np.empty((_STEP, width)), np.empty((_STEP, width))
        for batch in batches:
            for row, slot, weight in weighted_rows(batch, weights):
                if len(slot) > len(one):
                    one, two = np.empty((len(slot), width)), np.empty((len(slot), width))
                stops = np.flatnonzero(np.diff(row, append=-1)) + 1
                for low, high in zip([0, *stops[:-1].tolist()], stops.tolist()):
                    # a row's slots differ, so its products can be added in place
                    s, w, x = slot[low:high], weight[low:high], one[: high - low]
                    y = w @ np.take(b, s, axis=0, out=x, mode="clip")
                    np.take(total, s, axis=0, out=x, mode="clip")
                    x += np.multiply(w[:, None], y, out=two[: high - low])
                    total[s] = x
        yield from emit(total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SLOTS, width))
        for batch in batches:
            np.add.at(total, batch.column("slot").to_numpy(), batch.column("z").flatten().to_numpy().reshape(-1, width))
        yield from emit(total)

    schema = "slot int, z array<double>"
    got = rows.mapInArrow(products, schema).repartition("slot").mapInArrow(added, schema).toArrow()
    out = np.zeros((SLOTS, width))
    if got.num_rows:
        out[got["slot"].to_numpy()] = got["z"].combine_chunks().flatten().to_numpy().reshape(-1, width)
    return out


def fit(counted: DataFrame, components: int = 32, min_df: int = 2, extra: int = 10, rounds: int = 4, seed: int = 42) -> Projection:
    """The projection fitted on all rows of ``slot_counts``. Slots that fewer than ``min_df`` rows have weigh nothing. With fewer directions than ``components`` the rest of the basis is zero."""
    n = counted.count()

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sum((np.bincount(b.column("slots").flatten().to_numpy(), minlength=SLOTS) for b in batches), np.zeros(SLOTS, np.int64))
        own = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(found[own])], names=["slot", "n"])

    df = np.zeros(SLOTS)
    got = counted.select("slots").mapInArrow(holders, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df[got["slot"].to_numpy()] = got["n"].to_numpy()
    idf = np.where(df >= min_df, np.log((1.0 + n) / (1.0 + df)) + 1.0, 0.0)
    basis = np.random.default_rng(seed).normal(size=(SLOTS, components + extra))
    for _ in range(rounds):
        basis = np.linalg.qr(_pass(counted, idf, basis))[0]
    # Rayleigh-Ritz: the small matrix basis' A'A basis
    small = basis.T @ _pass(counted, idf, basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:components]
    values = np.sqrt(np.maximum(values[order], 0.0))
    real = values > 1e-6 * max(values.max(initial=0.0), 1e-300)
    vectors = np.where(real, basis @ turn[:, order], 0.0)
    vectors *= np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0)[0] < 0, -1.0, 1.0)
    return Projection(idf, vectors, np.where(real, values, 0.0))


def project(counted: DataFrame, model: Projection) -> DataFrame:
    """(key, vector): each row on the components; null where it has no term that weighs anything. No shuffle."""
    shipped = counted.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            out = np.zeros((batch.num_rows, m.basis.shape[1]))
            for row, slot, weight in weighted_rows(batch, m.idf):
                own, y = times(row, slot, weight, m.basis)
                out[own] = y
            vectors = [v if a else None for v, a in zip(out, out.any(axis=1))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(vectors, pa.list_(pa.float64()))], names=["key", "vector"])

    return counted.mapInArrow(run, f"key {dict(counted.dtypes)['key']}, vector array<double>")


def text_vectors(docs: DataFrame, text: str = "review_text", key: str = "review_id", components: int = 32, min_df: int = 2) -> DataFrame:
    """(key, vector) for every row of ``docs``: whole texts as terms (words of four letters or more and their pairs), reduced to ``components`` dimensions.
    Null and repeated keys stay; null texts, texts without a term and those whose terms are all too rare have a null vector."""
    counted = slot_counts(docs, T.terms(F.col(text)), key)
    return project(counted, fit(counted, components, min_df)).withColumnRenamed("key", key)
