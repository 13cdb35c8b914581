"""Domain adaptation of a masked-token model: context counts of a general corpus, and of the domain on top.

A token is predicted from its two neighbours. Counts of the three together are smoothed by those of each neighbour with it, and these by the token's own:
every level adds ``STRENGTH`` imagined observations in the proportions of the level below, so probabilities sum to one. Counts are all the model there is;
adapting it is adding counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.sources.scratch import materialize

STRENGTH = 2.0
MODELS = ("before", "after")
PLACE = ("left", "token", "right")
#: The words of a place that a level's key is made of.
LEVELS = {"t": (1,), "l": (0,), "r": (2,), "lt": (0, 1), "tr": (1, 2), "lr": (0, 2), "ltr": (0, 1, 2)}
PART, MOST_BITS = 1 << 19, 1 << 28


def contexts(docs: DataFrame, text: str = "review_text", key: str = "review_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, left, token, right) of every token of every text, and the columns of ``docs`` in ``carry``; '' stands beyond both ends."""
    found = T.tokens(F.col(text))
    rows = docs.select(key, *carry, found.alias("t")).select(key, *carry, "t", F.posexplode("t").alias("pos", "token"))
    side = lambda step: F.coalesce(F.get("t", F.col("pos") + step), F.lit(""))
    return rows.select(key, *carry, "pos", side(-1).alias("left"), "token", side(1).alias("right"))


def masked(key: Column, pos: Column, share: int = 15, seed: int = 42) -> Column:
    """About ``share`` tokens of a hundred, the same in every engine."""
    return (key * 7919 + pos * 104729 + key * pos * 31 + seed) % 100 < share


def context_counts(places: DataFrame) -> DataFrame:
    """(left, token, right, c)."""
    return places.groupBy("left", "token", "right").agg(F.count("*").alias("c"))


def smoothed(c, n: Column, v: Column) -> Column:
    """The probability of a token by the counts ``c(level)``, ``n`` tokens in all, ``v`` different ones."""
    alone = (c("t") + 1) / (n + v + 1)
    sides = (c("lt") + c("tr") + STRENGTH * alone) / (c("l") + c("r") + STRENGTH)
    return (c("ltr") + STRENGTH * sides) / (c("lr") + STRENGTH)


def probabilities(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """``asked`` (left, token, right, and others) with the probability ``p`` of each token between its neighbours, by ``counts``. Joins are on the aggregated counts."""
    seen = lambda *by, name: counts.groupBy(*by).agg(F.sum("c").alias(name))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.countDistinct("token").alias("v"))  # one row
    out = asked.crossJoin(F.broadcast(total))
    for by, name in ((("left", "token", "right"), "ltr"), (("left", "right"), "lr"), (("left", "token"), "lt"), (("token", "right"), "tr"), (("left",), "l"), (("right",), "r"), (("token",), "t")):
        out = out.join(seen(*by, name=name), list(by), "left")
    c = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")
    return out.select(*asked.columns, smoothed(c, F.col("n"), F.col("v")).alias("p"))


def perplexity(held: DataFrame, counts: DataFrame) -> DataFrame:
    """One row (n, perplexity) over masked places ``held``; equal places are asked once. Null without places."""
    asked = held.groupBy("left", "token", "right").agg(F.count("*").alias("times"))
    found = probabilities(asked, counts).agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"), (F.sum(F.col("times") * F.log("p")) / F.sum("times")).alias("mean"))
    return found.select("n", F.exp(-F.col("mean")).alias("perplexity"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit words whose bits each depend on all bits of ``x``."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _coded(batches: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """Words of the batches' places, a hash of each, and the numbers of the left, own and right words."""
    chunks = [b.column(n) for n in PLACE for b in batches]
    coded = pa.chunked_array(chunks, pa.string()).dictionary_encode("encode")
    words, codes = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
    return words, pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False), np.split(codes, len(PLACE))


def _slots(hashes: np.ndarray, codes: list[np.ndarray], level: str, bits: int) -> list[np.ndarray]:
    """Two slots of a table of ``bits`` (a power of two) for each key of ``level``; ``codes`` of its words in order."""
    key = np.full(len(codes[0]), list(LEVELS).index(level) + 1, np.uint64)
    for c in codes:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + hashes[c])
    return [(part & np.uint64(bits - 1)).astype(np.int64) for part in (key, key >> np.uint64(32))]


def asked_slots(asked: DataFrame) -> np.ndarray:
    """A table of bits, packed: set where one of the levels of ``asked`` (left, token, right) has a key. About 16 bits a key, at most MOST_BITS (32 MB); a table that is
    fuller tells less apart, but never leaves out a key. Tasks set the bits of a part each."""
    bits = 1 << int(np.clip(np.ceil(np.log2(16 * 5 * max(1, asked.count()))), 19, np.log2(MOST_BITS)))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, hashes, codes = _coded([batch])
                found = np.unique(np.concatenate([x for level, at in LEVELS.items() if level != "t" for x in _slots(hashes, [codes[i] for i in at], level, bits)]))
                parts, first = np.unique(found // PART, return_index=True)
                own = pa.array([x.astype(np.int32) for x in np.split(found % PART, first[1:])], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), own], names=["part", "slots"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own in zip(batch.column("part").to_pylist(), batch.column("slots")):
                held.setdefault(part, np.zeros(PART, bool))[own.values.to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], names=["part", "table"])

    rows = asked.select(*PLACE).mapInArrow(slots, "part int, slots array<int>").repartition("part")
    table = np.zeros(bits // 8, np.uint8)
    for part, own in rows.mapInArrow(packed, "part int, table binary").toLocalIterator():
        table[part * PART // 8 : (part + 1) * PART // 8] = np.frombuffer(own, np.uint8)
    return table


def level_sums(learned: DataFrame, table: np.ndarray, step: int = 1 << 26) -> DataFrame:
    """(level, left, token, right, before, after) of ``learned`` (left, token, right, general): how often each key of a level occurs, in general rows and in all; words that are not of the
    level are null. All tokens, and of the other levels what ``table`` (``asked_slots``) has, every key asked for among them. Added up within tasks only, for every ``step`` bytes of places."""
    shipped, bits = learned.sparkSession.sparkContext.broadcast(table), len(table) * 8

    def sums(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, hashes, codes = _coded(held)
        general, n = np.concatenate([b.column("general").to_numpy(zero_copy_only=False) for b in held]), len(words)

        def known(level: str, own: list[np.ndarray]) -> np.ndarray:
            one, two = ((shipped.value[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 for x in _slots(hashes, own, level, bits))
            return (one & two).astype(bool)

        def rows(level: str, own: list[np.ndarray], before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
            sides = dict(zip(LEVELS[level], own))
            columns = [words.take(pa.array(sides[i])) if i in sides else pa.nulls(len(after), pa.string()) for i in range(len(PLACE))]
            return pa.RecordBatch.from_arrays([pa.array([level] * len(after), pa.string()), *columns, pa.array(before.astype(np.int64)), pa.array(after.astype(np.int64))], names=["level", *PLACE, "before", "after"])

        def counted(level: str, key: np.ndarray, general: np.ndarray, sides) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
            every, at, after = np.unique(key, return_inverse=True, return_counts=True)
            own = sides(every)
            keep = np.ones(len(every), bool) if level == "t" else known(level, own)
            return rows(level, [x[keep] for x in own], np.bincount(at, general, len(every))[keep], after[keep]), every, at, keep[at]

        for level in ("t", "l", "r"):
            yield counted(level, codes[LEVELS[level][0]], general, lambda key: [key])[0]
        # a context that is asked for has all its pairs asked for
        some, pairs, pair = np.ones(len(general), bool), None, None
        for level in ("lr", "tr", "lt"):
            one, two = (codes[i] for i in LEVELS[level])
            found, pairs, pair, hit = counted(level, one * n + two, general, lambda key: [key // n, key % n])
            yield found
            some &= hit
        yield counted("ltr", pair[some] * n + codes[2][some], general[some], lambda key: [pairs[key // n] // n, pairs[key // n] % n, key % n])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= step:
                yield from sums(held)
                held, size = [], 0
        if held:
            yield from sums(held)

    return learned.select(*PLACE, "general").mapInArrow(run, "level string, left string, token string, right string, before long, after long")


def compared(held: DataFrame, learned: DataFrame, general: Column) -> DataFrame:
    """(model, n, perplexity): masked places ``held`` by the counts of the ``general`` rows of ``learned`` (before) and of all its rows (after).

    Both models' counts stand side by side. Places are added up in their tasks, and only keys that may be asked for leave them (``level_sums``), so what is shuffled and
    written grows with the masked places and the vocabulary, not with the contexts of the whole corpus."""
    asked = materialize(held.groupBy(*PLACE).agg(F.count("*").alias("times")))
    sums = level_sums(learned.select(*PLACE, F.coalesce(general, F.lit(False)).alias("general")), asked_slots(asked))
    counts = materialize(sums.groupBy("level", *PLACE).agg(*[F.sum(m).alias(m) for m in MODELS]))
    tokens = counts.where("level = 't'")
    total = tokens.agg(*[f(m) for m in MODELS for f in (lambda m: F.coalesce(F.sum(m), F.lit(0)).alias(f"{m}_n"), lambda m: F.count_if(F.col(m) > 0).alias(f"{m}_v"))])  # one row
    out = asked.crossJoin(F.broadcast(total))
    for level, own in LEVELS.items():
        by = [PLACE[i] for i in own]
        out = out.join(counts.where(F.col("level") == level).select(*by, *[F.col(m).alias(f"{m}_{level}") for m in MODELS]), by, "left")

    def log_p(m: str) -> Column:
        c = lambda name: F.coalesce(F.col(f"{m}_{name}"), F.lit(0)).cast("double")
        return F.log(smoothed(c, F.col(f"{m}_n"), F.col(f"{m}_v")))

    sums = out.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"), *[(F.sum(F.col("times") * log_p(m)) / F.sum("times")).alias(m) for m in MODELS])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.exp(-F.col(m)).alias("perplexity")) for m in MODELS]))
    return sums.select("n", rows.alias("x")).select("x.model", "n", "x.perplexity")


def adapted(general: DataFrame, domain: DataFrame) -> DataFrame:
    """Counts of the general corpus with those of the domain added."""
    return general.unionByName(domain).groupBy("left", "token", "right").agg(F.sum("c").alias("c"))
