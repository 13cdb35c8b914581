"""Alignment of two tokenizers over the same bytes.

Each text becomes a label string with one label per byte: 0 no token ends here, 1 one of A, 2 one of B, 3 both. A regular
expression takes the spans up to each 3; the labels inside a span count the tokens of its group. Between two neighbouring ends
of either kind lies exactly one pair of overlapping tokens, so the links of a text are its non-zero labels. How often a pair of ids is linked in the
whole corpus is counted by Spark and brought back to each text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import join_hot, materialize, small
from gleanery.llm.token_counts import LETTERS, PLAIN

GROUPS = "a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>, byte_ends array<long>"
COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
FINAL = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: A pair of ids as one long.
SHIFT = 1 << 31
_SPAN = re.compile(rb"[^3]*3")
_ODD = regex.compile(rf"[^\x00-\u{PLAIN - 1:04x}]")


class Pair:
    """Both tokenizers of a task: ids of a text, and the bytes of every id."""

    def __init__(self, a_path: str, b_path: str, pattern: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        code = {c: b for b, c in LETTERS.items()}
        special = {x["content"] for x in spec["added_tokens"]}
        spelled = {i: x.encode() if x in special else bytes(code[c] for c in x) for x, i in spec["model"]["vocab"].items()}
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        ranks = {spelled[i]: i for x, i in spec["model"]["vocab"].items() if x not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # ids in decimal with each of the three marks that may follow
        self.names = np.array([f"{i}{mark}" for size in (len(self.a_bytes), len(self.b_bytes)) for mark in (",", "|", ";") for i in range(size)], object)

    def ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both for a text, None if either doesn't give back the text's bytes after a space. Texts of long assigned
        characters take the faster library, which has the same merges; others the vocabulary's own."""
        spaced = " " + text
        a = self.a.encode(spaced, add_special_tokens=False).ids if _ODD.search(text) else self.fast.encode_ordinary(spaced)
        b = self.b.encode(text)
        data = spaced.encode()
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return None
        return a, b

    def labels(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A label for each byte, as the digits 0 to 3."""
        ends = np.cumsum(self.a_len[a])
        out = np.full(int(ends[-1]), 48, np.uint8)
        out[ends - 1] += 1
        out[np.cumsum(self.b_len[b]) - 1] += 2
        return out

    def digest(self, a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> str:
        """Of a1,a2|b1;a3|b2,b3: ids by group."""
        a_group, b_group = np.repeat(np.arange(len(a_sizes)), a_sizes), np.repeat(np.arange(len(b_sizes)), b_sizes)
        a_stop, b_stop = np.cumsum(a_sizes), np.cumsum(b_sizes)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[a_stop - 1], mark_b[b_stop - 1] = 1, 2
        na, nb = len(self.a_bytes), len(self.b_bytes)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], b_stop])[a_group]] = mark_a * na + a
        order[np.arange(len(b)) + a_stop[b_group]] = 3 * na + mark_b * nb + b
        return hashlib.sha256("".join(self.names[order].tolist())[:-1].encode()).hexdigest()


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str, pattern: str) -> Pair:
    return Pair(a_path, b_path, pattern)


def group_sizes(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of A and of B in each span of a label string, and where the spans end."""
    spans = _SPAN.findall(labels.tobytes())
    a = np.array([s.count(b"1") + 1 for s in spans], np.int64)
    b = np.array([s.count(b"2") + 1 for s in spans], np.int64)
    return a, b, np.cumsum([len(s) for s in spans])


def links(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pair of ids of each link: between neighbouring ends lies the overlap of one token of A and one of B."""
    ends = labels[labels != 48] - 48
    before = lambda bit: np.cumsum((ends & bit) > 0) - ((ends & bit) > 0)
    return a[before(1)] * SHIFT + b[before(2)]


def _encoder(a_path: str, b_path: str, pattern: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(a_path, b_path, pattern)
        task, seen = TaskContext.get().partitionId() << 40, 0
        for batch in small(batches, 4 << 20):
            rows, pairs, times, kept = [], [], [], []
            for x in batch.column("text"):
                text = x.as_py()
                found = both.ids(text) if text else None
                if found is None:
                    rows.append((0, 0, 0, 0, ""))
                    pairs.append([])
                    times.append([])
                    kept.append(([],) * 5)
                    continue
                a, b = (np.array(i, np.int64) for i in found)
                labels = both.labels(a, b)
                a_sizes, b_sizes, ends = group_sizes(labels)
                own, count = np.unique(links(labels, a, b), return_counts=True)
                rows.append((len(a), len(b), len(ends), int(count.sum()), both.digest(a, b, a_sizes, b_sizes)))
                pairs.append(own)
                times.append(count.astype(np.int32))
                if keep:
                    kept.append((a, b, a_sizes, b_sizes, ends))
            n = len(rows)
            columns = [pa.array(range(task + seen, task + seen + n), pa.int64()), batch.column("doc_id")]
            columns += [pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]] + [pa.array([r[4] for r in rows], pa.string())]
            columns += [pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
            if keep:
                columns += [pa.array([k[i] for k in kept], pa.list_(pa.int64() if i == 4 else pa.int32())) for i in range(5)]
            seen += n
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"] + [c.split()[0] for c in GROUPS.split(", ")] * keep
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pair_counts(coded: DataFrame) -> DataFrame:
    """(pair, count, best, texts) over the whole corpus: links that hold the pair, whether no pair of its B id holds more, and texts that have it."""
    rows = coded.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = materialize(rows.groupBy("pair").agg(F.sum("times").alias("count"), F.count("*").alias("texts")))
    # one row an id of B: bounded by its vocabulary
    most = counts.groupBy((F.col("pair") % SHIFT).alias("b")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), F.col("pair") % SHIFT == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"), "texts")


def _looked_up(coded: DataFrame, counts: DataFrame) -> DataFrame:
    """n_best and count_sum where the table of pairs is small enough to be held by every task, as sorted arrays."""
    got = counts.select("pair", "count", "best").toArrow().sort_by("pair")
    shipped = coded.sparkSession.sparkContext.broadcast((got["pair"].to_numpy(), got["count"].to_numpy(), got["best"].to_numpy(zero_copy_only=False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = shipped.value
        for batch in small(batches):
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(keys, pairs.flatten().to_numpy())
            sums = np.zeros((2, len(at) + 1), np.int64)
            if len(at):
                np.cumsum(times * best[at], out=sums[0, 1:])
                np.cumsum(times * count[at], out=sums[1, 1:])
            ends = np.cumsum(np.concatenate([[0], pairs.value_lengths().to_numpy()]))
            own = sums[:, ends[1:]] - sums[:, ends[:-1]]
            rest = [n for n in batch.schema.names if n not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(own[0]), pa.array(own[1])], names=[*rest, "n_best", "count_sum"])

    schema = coded.drop("pairs", "times").schema
    return coded.mapInArrow(run, schema.add("n_best", "long").add("count_sum", "long"))


def _joined(coded: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a shuffled join for a table of any size; pairs that very many texts have are broadcast to them."""
    rows = coded.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    facts = join_hot(rows, counts, "pair", "texts")
    sums = facts.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return coded.drop("pairs", "times").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, keep: bool = False, most_pairs: int = 3_000_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with ``keep`` also the ids of
    both (a_ids, b_ids), the tokens of each group (a_sizes, b_sizes) and the byte after each (byte_ends, the leading space included).

    Null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have no tokens: zeros and ''. doc_id may be null or
    repeat; rows map one to one, and repeated ones count each time. Whole texts are encoded; very long ones take memory in proportion. Ids of equal
    count for one B id are all best. No rows give none; other columns of ``docs`` aren't read. Texts are encoded once; what is shuffled are pairs of ids, added up in the tasks first.
    Up to ``most_pairs`` distinct pairs (17 bytes each) the counts are broadcast, beyond that joined."""
    schema = f"row long, {COUNTS}, pairs array<long>, times array<int>" + (f", {GROUPS}" if keep else "")
    coded = materialize(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_encoder(a_path, b_path, pattern, keep), schema))
    counts = materialize(pair_counts(coded))
    out = (_looked_up if counts.count() <= most_pairs else _joined)(coded, counts)
    return out.select(*FINAL, *([c.split()[0] for c in GROUPS.split(", ")] if keep else []))
