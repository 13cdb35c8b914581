"""Removal of repeated 50-word passages by super-k-mer partitioning.

Each window of ``window`` words is represented by its minimiser, the smallest hash among its runs of ``gram`` words.
Consecutive windows of a document that share a minimiser form a super-k-mer. Windows with equal words have equal
minimisers, so whether a window repeats is settled inside its minimiser's bucket.

1. Each document's super-k-mers are listed as (minimiser, 128-bit digest, place, number of windows), without any text. A
   grouped minimum and maximum of doc_id by minimiser, combined before the shuffle, shows which minimisers more than one
   document has; only their super-k-mers go on. Equal ones are stood for by that of the smallest doc_id.
2. Each of those travels once, as one packed string, to the bucket of its minimiser, where windows are sorted exactly: runs
   of equal windows give the smallest doc_id of each. A minimiser that more than ``hot`` super-k-mers have could make a
   bucket too large for a task; its windows go singly, by digests that deal them and by which equal windows combine.
3. Super-k-mers with a window that starts in a document with a smaller doc_id are joined back to the places where
   they occur, those with very many places by broadcast, which gives each document its covered word ranges; the kept words are put together from the whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.llm.common import gram_hashes, join_hot, materialize, small, word_hashes, words_of

PLACES = "doc_id long, body long, mini array<long>, key array<binary>, start array<int>, count array<int>"


def super_kmers(words: list[bytes], window: int, gram: int, span: int = 64) -> tuple[np.ndarray, ...]:
    """(minimiser, first window, number of windows) of each super-k-mer of a document. A periodic text has one
    minimiser throughout: runs are cut at ``span`` windows, so no super-k-mer is longer than ``span + window - 1`` words."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    low = gram_hashes(word_hashes(words), gram)
    reach, have = window - gram + 1, 1
    while have < reach:  # minimum over ``reach`` neighbours by doubling
        step = min(have, reach - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    place = np.arange(len(low))
    begun = np.maximum.accumulate(np.where(np.append(True, low[1:] != low[:-1]), place, 0))
    first = np.flatnonzero((place - begun) % span == 0)
    count = np.diff(np.append(first, len(low)))
    return low[first].view(np.int64), first.astype(np.int32), count.astype(np.int32)


def body_of(words: list[bytes]) -> int:
    """A 64-bit hash of a document's words: tells rows apart that share a doc_id."""
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _list_places(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            bodies, found, keys = [], [], []
            for x in batch.column("text"):
                words = words_of(x.as_py())
                bodies.append(body_of(words))
                found.append(own := super_kmers(words, window, gram))
                keys += [_digest(b" ".join(words[a : a + n - 1 + window])) for a, n in zip(own[1].tolist(), own[2].tolist())]
            ends = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
            mini, start, count = (pa.array(np.concatenate([f[i] for f in found]), k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32())))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (mini, pa.array(keys, pa.binary()), start, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bodies, pa.int64()), *lists], names=["doc_id", "body", "mini", "key", "start", "count"])

    return run


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], dict]]:
    """(doc_id, words, super-k-mer) of rows (doc_id, text, pick: array<struct<body, mini, key, start, count>>), without those of
    another row with the doc_id; a row that follows with the same words is passed over."""
    last, seen = None, set()
    for batch in small(batches):
        for doc, text, pick in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("pick")):
            words = words_of(text.as_py())
            body = body_of(words)
            if doc != last:
                last, seen = doc, set()
            if body in seen:
                continue
            seen.add(body)
            yield from ((doc, words, p) for p in pick.as_py() if p["body"] == body)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _pack(window: int, size: int = 4 << 20):
    """Picked super-k-mers as packed strings (bucket, key, packed, least), in batches of about ``size`` bytes."""
    names, kinds = ["bucket", "key", "packed", "least"], [pa.int64(), pa.binary(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for doc, words, p in _picked(batches):
            packed = b" ".join(words[p["start"] : p["start"] + p["count"] - 1 + window])
            out.append((p["mini"], p["key"], packed, doc))
            held += 200 + len(packed)
            if held > size:
                yield _table(out, names, kinds)
                out, held = [], 0
        yield _table(out, names, kinds)

    return run


def _single(window: int):
    """Picked super-k-mers as their windows' digests (key, i, digest, least)."""
    names, kinds = ["key", "i", "digest", "least"], [pa.binary(), pa.int32(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc, words, p in _picked(batches):
            out += [(p["key"], i, _digest(b" ".join(words[p["start"] + i : p["start"] + i + window])), doc) for i in range(p["count"])]
            if len(out) > 20_000:
                yield _table(out, names, kinds)
                out = []
        yield _table(out, names, kinds)

    return run


def first_owners(packed: list[bytes], owner: np.ndarray, window: int) -> pa.ListArray:
    """For each window of each packed string the smallest ``owner`` among the strings that hold it. Windows are sorted exactly, as
    suffixes are: ranks of words become ranks of 2, 4, 8 ... words, so no window is copied."""
    lists = pc.split_pattern(pa.array(packed, pa.binary()), b" ")
    rank = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    have = 1
    while have < window:
        step = min(have, window - have)
        rank = np.unique(rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1]
        have += step
    counts = sizes - window + 1
    ends = np.cumsum(counts)
    # windows that lie inside one string
    at = np.arange(ends[-1]) + np.repeat(np.cumsum(sizes) - sizes - ends + counts, counts)
    same = rank[at]
    least = np.full(int(same.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, same, np.repeat(owner, counts))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(least[same], pa.int64()))


def _sort_buckets(window: int, size: int = 4 << 20):
    """Rows (bucket, key, packed, least), sorted by bucket, to (key, firsts: smallest doc_id of each window). Whole buckets are sorted
    together up to about ``size`` bytes: equal windows never lie in two buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, texts, owners, held = None, [], [], [], 0

        def settled() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), first_owners(texts, np.array(owners, np.int64), window)], names=["key", "firsts"])

        for batch in small(batches):
            for bucket, key, packed, least in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "packed", "least"))):
                if bucket != now:
                    now = bucket
                    if held > size:
                        yield settled()
                        keys, texts, owners, held = [], [], [], 0
                keys.append(key)
                texts.append(packed)
                owners.append(least)
                held += len(packed)
        if keys:
            yield settled()

    return run


def _rebuild(carry: tuple[str, ...]):
    """``carry``: columns that go on as they are, but for text, which goes on without the removed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for given, ranges in zip(batch.column("text"), batch.column("ranges")):
                words = words_of(given := given.as_py())
                gone = np.zeros(len(words) + 1, np.int32)
                found = ranges.as_py() or ()
                body = body_of(words) if found else None
                for r in found:
                    if r["body"] == body:
                        gone[r["a"]] += 1
                        gone[r["b"]] -= 1
                left = (np.cumsum(gone[:-1]) == 0).nonzero()[0].tolist()
                whole = len(left) == len(words)
                text = b" ".join(words if whole else [words[i] for i in left])
                rows.append((len(words), len(words) - len(left), hashlib.sha256(text).hexdigest(), given if whole else text.decode()))
            kinds = [pa.int64(), pa.int64(), pa.string()]
            cols = [batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))]
            cols += [pa.array([r[3] for r in rows], pa.string()) if c == "text" else batch.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", *carry])

    return run


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 8, hot: int = 2000, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, and the columns of ``docs``
    in ``carry``; a carried text is as it was where nothing goes, else the kept words joined by one space.

    A word goes if a window that covers it has the same words as a window of a document with a smaller doc_id. Null
    text has no words. Rows with a null doc_id are neither judged nor compared and keep all words. Rows that repeat a
    doc_id are not repeats of each other; each is judged by its own words. Texts under ``window`` words keep all. Very
    long texts, periodic ones too, travel in super-k-mers of bounded length. Other columns are ignored; no rows give none.
    """
    rest = [c for c in carry if c != "text"]
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *rest)
    named = "doc_id is not null and text is not null"
    # each of the passes that need whole texts deals them by doc_id: packing, windows of hot minimisers, rebuilding
    rows = every.where(named).repartition("doc_id")
    places = materialize(every.where(named).mapInArrow(_list_places(window, gram), PLACES).where("size(mini) > 0"))
    flat = places.select("doc_id", "body", F.explode(F.arrays_zip("mini", "key", "start", "count")).alias("p")).select("doc_id", "body", "p.*")
    shared = materialize(flat.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("mini", "n"))
    mine = materialize(join_hot(flat, shared, "mini", "n").where("n is not null"))
    # of equal super-k-mers the one of the smallest doc_id
    reps = mine.groupBy("mini", "key", "n").agg(F.min(F.struct("doc_id", "body", "start", "count")).alias("r")).select("mini", "key", "n", "r.*")
    # a document's super-k-mers are at most as many as its words
    pick = lambda some: rows.join(reps.where(some).groupBy("doc_id").agg(F.collect_list(F.struct("body", "mini", "key", "start", "count")).alias("pick")), "doc_id").select("doc_id", "text", "pick")
    packed = pick(f"n <= {hot}").mapInArrow(_pack(window), "bucket long, key binary, packed binary, least long")
    firsts = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets(window), "key binary, firsts array<long>")
    single = materialize(pick(f"n > {hot}").mapInArrow(_single(window), "key binary, i int, digest binary, least long"))
    least = materialize(single.groupBy("digest").agg(F.min("least").alias("least"), F.count("*").alias("n")))
    settled = join_hot(single.select("key", "i", "digest"), least, "digest", "n")
    settled = settled.groupBy("key").agg(F.transform(F.sort_array(F.collect_set(F.struct("i", "least"))), lambda x: x.least).alias("firsts"))
    found = firsts.unionByName(settled).groupBy("key").agg(F.first("firsts").alias("firsts"))
    found = materialize(found.join(mine.groupBy("key").agg(F.count("*").alias("n")), "key"))
    # a super-k-mer that a great share of the documents hold reaches its places by broadcast
    owned = join_hot(mine.select("doc_id", "body", "key", "start"), found, "key", "n")
    hits = owned.select("doc_id", "body", "start", F.expr("filter(transform(firsts, (f, i) -> if(f < doc_id, i, null)), i -> i is not null)").alias("at")).where("size(at) > 0")
    # each run of neighbouring windows is one range of words
    begins = "filter(transform(at, (x, i) -> struct(x as x, coalesce(get(at, i - 1), -9) as p)), s -> s.x <> s.p + 1)"
    length = "aggregate(at, 0, (n, y) -> if(y = s.x + n, n + 1, n))"
    spans = F.expr(f"transform({begins}, s -> struct(start + s.x as a, start + s.x + {length} + {window - 1} as b, body))")
    ranges = hits.select("doc_id", F.explode(spans).alias("r")).groupBy("doc_id").agg(F.collect_set("r").alias("ranges"))
    schema = StructType([*StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string"), *(docs.schema[c] for c in carry)])
    done = rows.join(ranges, "doc_id", "left").select("doc_id", "text", *rest, "ranges").mapInArrow(_rebuild(carry), schema)
    others = every.where(f"not ({named})").withColumn("ranges", F.lit(None).cast("array<struct<a: int, b: int, body: bigint>>"))
    return done.unionByName(others.mapInArrow(_rebuild(carry), schema))
