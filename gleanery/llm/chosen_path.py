"""Jaccard join of texts on their word shingles by chosen paths.

1. A text is the set of its hashed runs of ``words`` words. Texts with the same set are one node, carried by its
   smallest doc_id; copies are counted, never paired. A node is embedded as ``TOKENS`` minhash tokens (place, value),
   whose overlap estimates the Jaccard similarity, as chosen-path joins do before they split.
2. Each run starts at one sampled place: nodes that share its token meet in a bucket. A bucket above ``limit`` nodes is
   split again on ``BRANCH`` further sampled places, its path hash choosing them, and so on. A bucket whose members mostly
   share every sampled token can't be split any more; it, and every bucket that is small, is compared by brute force. Large
   ones are compared in cells of two bounded slices, so nothing larger than a cell ever meets in a task and no pair is dropped.
   The first runs are as many as the target recall asks for at ``PLANNED`` splits. Then recall is measured: the nodes of
   all rows whose id is divisible by 100 are held against all nodes, in blocks; of the pairs whose tokens agree as at the
   threshold, the share that met in a bucket counts. While it is below the target, as many runs again follow.
3. A pair is compared only in the first of the buckets that both nodes have. What the tokens leave as possible is
   settled on the shingle sets of the whole texts, exactly. A cell returns a link count and one parent for each node:
   never a row for a pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.llm.common import U64, connected_components, gram_hashes, grouped, join_hot, materialize, mix, roots, small, word_hashes, words_of

TOKENS, BRANCH, DEEPEST = 64, 2, 12
#: Splits that the first runs allow for.
PLANNED = 2
_FACTOR = mix(np.arange(11, 11 + TOKENS, dtype=U64)) | U64(1)
_SHIFT = mix(np.arange(7001, 7001 + TOKENS, dtype=U64))
#: Tokens that two nodes must share to be settled exactly; at similarity 0.8 fewer are six deviations away.
AGREE = 32


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted set of hashed runs of ``words`` words; a shorter text is one run. None without words."""
    found = words_of(text)
    if not found:
        return np.empty(0, U64)
    return np.unique(gram_hashes(word_hashes(found), min(words, len(found))))


def node_of(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def tokens(grams: np.ndarray, step: int = 2048) -> np.ndarray:
    """Minhash values of a set, in blocks of ``step`` shingles."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, U64)
    for at in range(0, len(grams), step):
        np.minimum(low, (grams[at : at + step, None] * _FACTOR + _SHIFT).min(axis=0), out=low)
    return (low >> U64(32)).astype(np.uint32)


def runs_for(recall: float, threshold: float, splits: int = PLANNED) -> int:
    """Runs after which a pair at ``threshold`` has met with probability ``recall``, if its buckets are split ``splits``
    times: a run keeps it if it shares the first token and one of each split's."""
    kept = threshold * (1 - (1 - threshold) ** BRANCH) ** splits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - kept)))


def _mark(words: int, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            nodes, sizes, sigs = [], [], []
            for x in batch.column("text"):
                grams = shingles(x.as_py(), words)
                nodes.append(node_of(grams) if len(grams) else None)
                sizes.append(len(grams))
                sigs.append(tokens(grams).view(np.int32) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.list_(pa.int32())), *(batch.column(c) for c in carry)],
                names=["doc_id", "node", "size", "sig", *carry],
            )

    return run


CELL = ["bucket", "i", "j"]


def shared(row: np.ndarray, value: np.ndarray, n: int, width: int = 2048) -> np.ndarray:
    """How many values each pair of n rows has in common, by products of incidence blocks of ``width`` values; (row, value) don't repeat."""
    _, at, count = np.unique(value, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    keep = count[at] > 1
    row, at = row[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    total = np.zeros((n, n), np.float32)  # exact up to 2^24 values
    block = np.zeros((n, width), np.float32)
    for start in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        lo, hi = np.searchsorted(at, (start, start + width))
        block[row[lo:hi], at[lo:hi] - start] = 1
        total += block @ block.T
        block[row[lo:hi], at[lo:hi] - start] = 0
    return total


def _pairs(table: pa.Table, key: tuple) -> np.ndarray:
    """Which pairs of a cell's rows (bucket, i, j, slice, size, buckets) are its own: across slices if it has two, of
    fitting sizes, and without an earlier bucket in common. A symmetric matrix."""
    bucket, i, j = key
    part, size = table["slice"].to_numpy(), table["size"].to_numpy().astype(np.int64)
    own = (part[:, None] != part[None, :]) if i != j else ~np.eye(len(part), dtype=bool)
    lists = table["buckets"].combine_chunks()
    flat, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(part)), lengths)
    before = flat < bucket
    if before.any():
        own &= shared(row[before], flat[before], len(part)) == 0
    return own, size


def _screen(threshold: float):
    """Cells to the nodes that have a possible partner in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            cols = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, names=[*CELL, "slice", "node"])

        for key, table in grouped(batches, CELL):
            if len(table) < 2:
                continue
            own, size = _pairs(table, key)
            own &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9
            sig = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(table), TOKENS)
            hit = np.zeros(len(table), bool)
            for at in range(0, len(table), 64):
                same = (sig[at : at + 64, None, :] == sig[None, :, :]).sum(axis=2, dtype=np.uint8)
                hit[at : at + 64] = ((same >= AGREE) & own[at : at + 64]).any(axis=1)
            if hit.any():
                nodes, part = table["node"].to_pylist(), table["slice"].to_pylist()
                out += [(*key, part[k], nodes[k]) for k in np.flatnonzero(hit).tolist()]
            if len(out) > 20_000:
                yield batch_of()
                out = []
        yield batch_of()

    return run


SETS = "bucket long, i int, j int, slice int, node binary, size int, copies long, buckets array<long>, grams binary"


def _bring(words: int):
    """Rows (text, node, copies, buckets, cells) to a row for each cell with the node's set. A row with another text of the same doc_id is passed over."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    names = [*CELL, "slice", "node", "size", "copies", "buckets", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out, held = [], 0
            for text, node, copies, buckets, cells in zip(*(batch.column(c) for c in ("text", "node", "copies", "buckets", "cells"))):
                grams = shingles(text.as_py(), words)
                if node_of(grams) != node.as_py():
                    continue
                for c in cells.as_py():
                    out.append((c["bucket"], c["i"], c["j"], c["slice"], node.as_py(), len(grams), copies.as_py(), buckets.as_py(), grams.tobytes()))
                    held += 8 * len(grams)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return run


def _settle(threshold: float):
    """Cells with sets to (node, links, parent): exact links weighted by the partners' copies, and the cell's root of each linked node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.binary()))], names=["node", "links", "parent"])

        for key, table in grouped(batches, CELL):
            nodes = table["node"].to_pylist()
            if len(set(nodes)) < len(nodes):  # repeated rows
                table = table.take([nodes.index(x) for x in sorted(set(nodes))])
                nodes = table["node"].to_pylist()
            if len(nodes) < 2:
                continue
            own, size = _pairs(table, key)
            inter = shared(np.repeat(np.arange(len(nodes)), size), np.frombuffer(b"".join(table["grams"].to_pylist()), U64), len(nodes)).astype(np.float64)
            own &= inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
            a, b = np.nonzero(own)
            root = roots(len(nodes), (a, b))
            links = own @ table["copies"].to_numpy()
            out += [(nodes[k], int(links[k]), nodes[root[k]]) for k in np.flatnonzero(links).tolist()]
            if len(out) > 20_000:
                yield batch_of()
                out = []
        yield batch_of()

    return run


def split_runs(sig: DataFrame, runs: range, limit: int) -> DataFrame:
    """Final buckets (bucket, n, node) of ``sig`` (node, sig) in ``runs``: those with two nodes or more that are small, can't be split or lie deepest."""
    rows = sig.select("node", F.explode(F.expr(f"transform(array({', '.join(map(str, runs))}), r -> xxhash64(0L, r, sig[r % {TOKENS}]))")).alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    now = materialize(rows.join(counts, "bucket"))
    done = [now.where(f"n <= {limit}").select("bucket", "n", "node")]
    for depth in range(1, DEEPEST + 1):
        large = now.where(f"n > {limit}")
        if large.isEmpty():
            break
        places = f"transform(sequence(1, {BRANCH}), k -> int(pmod(xxhash64(bucket, {depth}, k), {TOKENS})))"
        below = large.join(sig, "node").select("node", F.col("bucket").alias("up"), F.col("n").alias("n_up"), F.explode(F.expr(f"transform({places}, p -> struct(p, sig[p] as v))")).alias("t"))
        below = materialize(below.select("node", "up", "n_up", F.xxhash64("up", "t.p", "t.v").alias("bucket")).distinct())
        counts = below.groupBy("up", "n_up", "bucket").agg(F.count("*").alias("n"))
        # the mean share of pairs of a bucket that stay together: from 0.3 on many of its members are alike, and all are compared as they are
        alike = counts.groupBy("up").agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.max(F.lit(float(BRANCH)) * F.col("n_up") * F.col("n_up"))).alias("share"))
        split = materialize(counts.join(alike, "up").select("up", "bucket", "n", ((F.col("share") < 0.3) & F.lit(depth < DEEPEST)).alias("split")))
        whole = split.where("not split").select(F.col("up").alias("bucket")).distinct()
        done.append(large.join(whole, "bucket").select("bucket", "n", "node"))
        now = materialize(below.select("node", "up", "bucket").join(split.where("split and n > 1").select("up", "bucket", "n"), ["up", "bucket"]).select("bucket", "n", "node"))
        done.append(now.where(f"n <= {limit}"))
    return materialize(reduce(DataFrame.unionByName, done))


def _matches(values: np.ndarray, ordered: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into values, owner) of all equal pairs of ``values`` and the sorted ``ordered``, whose entries belong to ``owner``."""
    lo, hi = np.searchsorted(ordered, values, "left"), np.searchsorted(ordered, values, "right")
    size = hi - lo
    at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
    return np.repeat(np.arange(len(values)), size), owner[at]


def _meet(asked: pa.Table, least: int, step: int = 256):
    """Rows (node, sig, buckets) to (asked, agree, met): for each asked node the other nodes that agree in ``least`` tokens or more, and those of them in a bucket with it."""
    names = asked["node"].to_pylist()
    sig = asked["sig"].combine_chunks().flatten().to_numpy().reshape(len(names), TOKENS)
    order = np.argsort(sig, axis=0, kind="stable")
    ordered = np.take_along_axis(sig, order, 0)
    lists = asked["buckets"].combine_chunks()
    bucket, of = lists.flatten().to_numpy(), np.repeat(np.arange(len(names)), lists.value_lengths().fill_null(0).to_numpy())
    by = np.argsort(bucket, kind="stable")
    bucket, of = bucket[by], of[by]
    place = {name: k for k, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(names)), np.int64)
        for batch in small(batches):
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                own = part.column("sig").flatten().to_numpy().reshape(part.num_rows, TOKENS)
                agree = np.zeros((part.num_rows, len(names)), np.uint8)
                for p in range(TOKENS):
                    agree[_matches(own[:, p], ordered[:, p], order[:, p])] += 1
                hit = agree >= least
                for k, name in enumerate(part.column("node").to_pylist()):
                    if name in place:
                        hit[k, place[name]] = False
                if hit.any():
                    met = np.zeros(hit.shape, bool)
                    mine = part.column("buckets")
                    row = np.repeat(np.arange(part.num_rows), mine.value_lengths().fill_null(0).to_numpy())
                    at, to = _matches(mine.flatten().to_numpy(), bucket, of)
                    met[row[at], to] = True
                    total += np.stack([hit.sum(axis=0), (hit & met).sum(axis=0)])
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in some.tolist()], pa.binary()), *(pa.array(t[some], pa.int64()) for t in total)], names=["asked", "agree", "met"])

    return run


def measured_recall(nodes: DataFrame, threshold: float, block: int = 8192) -> float:
    """Of the pairs of an asked node and any other of ``nodes`` (node, sig, asked, buckets) whose tokens agree as at ``threshold``, the share that
    met in a bucket; the lesser of that of all pairs and the mean over asked nodes. All asked nodes count, about ``block`` in a pass."""
    passes = -(-nodes.where("asked > 0").count() // block)
    sums = np.zeros(4)
    for k in range(passes):
        some = nodes.where(F.expr(f"asked > 0 and pmod(xxhash64('asked', node), {passes}) = {k}")).select("node", "sig", "buckets").toArrow()
        if len(some):
            found = nodes.select("node", "sig", "buckets").mapInArrow(_meet(some, math.ceil(threshold * TOKENS)), "asked binary, agree long, met long").groupBy("asked").agg(F.sum("agree").alias("agree"), F.sum("met").alias("met"))
            sums += [float(x or 0) for x in found.agg(F.sum("agree"), F.sum("met"), F.count("*"), F.sum(F.expr("met / agree"))).first()]
    return float(min(sums[1] / sums[0], sums[3] / sums[2])) if sums[0] else 1.0


def buckets_of(nodes: DataFrame, recall: float, threshold: float, limit: int) -> DataFrame:
    """``nodes`` (node, sig, asked) with ``b``, the sorted final buckets array<struct<bucket, n>> of each (null without any), from as many runs as the measured recall asks for."""
    runs, parts = runs_for(recall, threshold), []
    more = range(runs)
    while True:
        parts.append(split_runs(nodes.select("node", "sig"), more, limit))
        listed = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sort_array(F.collect_set(F.struct("bucket", "n"))).alias("b"))
        out = materialize(nodes.join(listed, "node", "left").withColumn("buckets", F.expr("transform(b, x -> x.bucket)")))
        if measured_recall(out, threshold) >= recall:
            return out
        more = range(more.stop, 2 * more.stop)


def jaccard_join(docs: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.99999, limit: int = 512, cell: int = 512, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, n_links, rep_id, n_shingles, node, class_node, and the columns of ``docs`` in ``carry``.

    n_links: other rows whose shingle sets have a Jaccard similarity of ``threshold`` or more, copies included.
    class_id: smallest doc_id that links reach, rep_id: smallest doc_id with the same shingle set; node names that set and
    class_node the class, also where doc_ids repeat. Texts that are null or have no word link with nothing and are their
    own class (node and class_node null); those of fewer than ``words`` words are one shingle. Rows with a null doc_id have
    class_id and rep_id null and no links. Repeated rows are copies. Ties don't matter: classes go by their smallest id.
    Very long texts are hashed in blocks and compared whole. Other columns are ignored; no rows give none.
    """
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    kinds = StructType([*StructType.fromDDL("doc_id long, node binary, size int, sig array<int>"), *(docs.schema[c] for c in carry)])
    marks = materialize(every.mapInArrow(_mark(words, carry), kinds))
    usable = marks.where("doc_id is not null and node is not null")
    # copies combine before the shuffle
    nodes = usable.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.expr("count_if(doc_id % 100 = 0)").alias("asked"), F.min(F.struct("size", "sig")).alias("s"))
    nodes = buckets_of(materialize(nodes.select("node", "rep", "copies", "asked", "s.*")), recall, threshold, limit)
    sketch = F.expr("unhex(array_join(transform(sig, x -> lpad(hex(x & 255), 2, '0')), ''))")
    rich = nodes.where("b is not null")
    spread = rich.select("node", "size", sketch.alias("sketch"), "buckets", F.explode("b").alias("x")).select("*", "x.bucket", F.expr(f"int(ceil(x.n / {cell}))").alias("g")).drop("x")
    spread = spread.withColumn("slice", F.expr("int(pmod(xxhash64(node, bucket), g))"))
    cells = spread.withColumn("t", F.explode(F.expr("sequence(0, g - 1)"))).select("bucket", F.least("slice", "t").alias("i"), F.greatest("slice", "t").alias("j"), "slice", "node", "size", "sketch", "buckets")
    dealt = lambda df: df.repartition(*CELL).sortWithinPartitions(*CELL)
    needed = materialize(dealt(cells).mapInArrow(_screen(threshold), "bucket long, i int, j int, slice int, node binary"))
    wanted = needed.groupBy("node").agg(F.collect_list(F.struct(*CELL, "slice")).alias("cells")).join(rich.select("node", "rep", "copies", "buckets"), "node")
    sets = every.select("doc_id", "text").join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select("text", "node", "copies", "buckets", "cells").mapInArrow(_bring(words), SETS)
    found = materialize(dealt(sets).mapInArrow(_settle(threshold), "node binary, links long, parent binary"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reach = connected_components(found.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    reach = materialize(reach.join(nodes.select("node", "rep"), "node"))
    least = reach.groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = reach.join(least, "component").select("node", F.col("component").alias("class_node"), "class_id").join(links, "node", "left")
    result = nodes.select("node", "rep", "copies").join(classes, "node", "left")
    result = materialize(result.select("node", "copies", F.col("rep").alias("rep_id"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("class_node", "node").alias("class_node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    own = marks.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"), *carry)
    out = join_hot(own, result, "node", "copies")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("rep_id", "doc_id").alias("rep_id"), "n_shingles", "node", "class_node", *carry)
