"""Shared helpers: small batches, joins with heavy keys, hashing words, joining links into components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.sources.scratch import materialize

#: What separates words in every operator that speaks of words.
SPACES = "\\x20\\x09-\\x0D"
U64 = np.uint64


def small(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes, a row at least: what Python makes of a slice stays small. Freed memory goes back when the partition ends."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def join_hot(rows: DataFrame, facts: DataFrame, key: str, weight: str, shares: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``facts`` (one row a key) on ``key``. Keys with more than 1/``shares`` of the summed
    ``weight`` (the rows of each key) would overload a task: there are fewer than ``shares`` of them, whatever the table, so
    their facts are broadcast; only rows of lighter keys are shuffled. Rows with a null key go on without a join."""
    total = facts.agg(F.sum(weight).alias("n")).first().n or 0
    heavy = facts.where(F.col(weight) * shares > total)
    light = facts.where(F.col(weight) * shares <= total)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in facts.schema if f.name != key]
    keyed = rows.where(F.col(key).isNotNull())
    out = keyed.join(F.broadcast(heavy), key)
    out = out.unionByName(keyed.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left"))
    return out.unionByName(rows.where(F.col(key).isNull()).select("*", *blank))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits each depend on all input bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_PLACES = mix(np.arange(1, 4097, dtype=U64)) | U64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words between characters of SPACES; bytes.split() splits at just these."""
    return text.encode().split() if text else []


def word_hashes(words: list[bytes], step: int = 100_000) -> np.ndarray:
    """A 64-bit hash of each word: a multilinear sum over its bytes, mixed. The work runs in blocks of ``step`` words, so a very long text needs no more memory than that."""
    out = np.empty(len(words), U64)
    for at in range(0, len(words), step):
        block = words[at : at + step]
        buf = np.frombuffer(b" ".join(block) + b" ", np.uint8)
        sizes = np.fromiter(map(len, block), np.int64, len(block)) + 1
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(buf)) - np.repeat(starts, sizes)
        factor = _PLACES[place] if int(sizes.max()) <= len(_PLACES) else mix(place + 1) | U64(1)
        out[at : at + len(block)] = mix(np.add.reduceat((buf.astype(U64) + U64(1)) * factor, starts))
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of ``n`` consecutive words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, U64)
    total = np.zeros(count, U64)
    for j in range(n):
        total += hashes[j : j + count] * _PLACES[4095 - j]
    return mix(total)


def roots(n: int, pairs) -> np.ndarray:
    """Smallest index reachable from each of n indices by ``pairs`` (two arrays)."""
    label = np.arange(n)
    a, b = pairs
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node that links reach.

    Rounds of two star steps: each node hands its larger neighbours to its smallest one, then each hands its smaller
    neighbours over too. Rows stay linear in the edges, hubs are split by the joins' skew handling, and every round is written to the shared folder. A run that doesn't settle within ``rounds`` raises.
    """

    def star(rows: DataFrame, both: bool) -> DataFrame:
        if both:
            around = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            around = rows
        least = around.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        joined = around.join(least, "a")
        if both:  # larger neighbours go to the smallest
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # the node and its smaller neighbours go to the smallest
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    # every edge runs from its larger to its smaller end
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        now = materialize(star(star(now, True), False))
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal ``keys`` in sorted batches; a run may cross batches. One run is held at a time."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new).tolist()
        for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
            key = tuple(c[start] for c in cols)
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(start, stop - start))
    if held:
        yield now, pa.Table.from_batches(held)
