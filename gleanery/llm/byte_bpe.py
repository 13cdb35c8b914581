"""Byte-level BPE encoding in linear time by backtracking over longest matches, and decoding.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton finds every vocabulary entry in a piece. A
left-to-right walk takes the longest entry at each place and accepts it if it is compatible with the entry before:
two neighbours are compatible if merging their joined bytes would give just these two. If no entry fits, the walk
steps back and never returns to that place. A sequence whose neighbours are all compatible is the one that merging by
rank produces, so results equal those of merging. Compatibility is memoised per pair.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from gleanery.llm.common import small

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Encoder:
    """Encodes pieces of one rank file. ``memo`` bounds the entries of each memo; pieces of over 64 characters aren't held, so it bounds their bytes too."""

    def __init__(self, path: str, memo: int = 100_000):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for token, i in self.rank.items():
            self.bytes_of[i] = token
        self.halves = {i: self._last_merge(token) for token, i in self.rank.items()}
        self.joins = {ab[0] << 32 | ab[1]: i for i, ab in self.halves.items() if ab}
        self.size_of = list(map(len, self.bytes_of))
        self.shorter = [-1] * len(self.bytes_of)  # the longest other entry that begins an entry
        for token, i in self.rank.items():
            self.shorter[i] = next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), -1)
        self.trie = ahocorasick.Automaton()
        for token, i in self.rank.items():
            self.trie.add_word(token.decode("latin-1"), i)
        self.trie.make_automaton()
        self.size = memo
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(9)]

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two entries whose merge makes ``token``; None for single bytes and for entries that no merge reaches."""
        rank, parts = self.rank, [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 and all(p in rank for p in parts) else None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging keeps the border between two neighbours: undo merges from the latest to the earliest on
        both sides; at no time may the entries that touch the border have a merge that comes before what is undone."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        a, b, before = left, right, 1 << 60
        good = True
        while True:
            joined = self.joins.get(a << 32 | b)
            if joined is not None and joined < before:
                good = False
                break
            ha, hb = self.halves.get(a), self.halves.get(b)
            # the later merge is undone first; of equal ones the right one, as merging goes from the left
            if ha and (a > b or not hb):
                before, a = a, ha[1]
            elif hb:
                before, b = b + 1, hb[0]
            else:
                break
        if len(self.pairs) >= self.size:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def walk(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        text, known, fits, sizes, longest = piece.decode("latin-1"), self.pairs.get, self.fits, self.size_of, self.trie.iter_long
        out = [i for _, i in longest(text)]
        for k in range(1, len(out)):  # mostly the longest entries fit each other
            good = known(out[k - 1] << 32 | out[k])
            if not (fits(out[k - 1], out[k]) if good is None else good):
                break
        else:
            return out
        i, at, n = self.shorter[out[k]], sum(sizes[x] for x in out[:k]), len(piece)
        del out[k:]
        dead = bytearray(n + 1)
        while True:
            last = out[-1] if out else -1
            while i >= 0:
                if not dead[at + sizes[i]]:
                    good = True if last < 0 else known(last << 32 | i)
                    if fits(last, i) if good is None else good:
                        break
                i = self.shorter[i]
            if i >= 0:
                out.append(i)
                at += sizes[i]
                if at == n:
                    return out
                i = next(longest(text, at))[1]
            elif out:
                dead[at] = 1
                at -= sizes[last]
                i = self.shorter[out.pop()]
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def packed(self, piece: str) -> bytes:
        """Ids of a piece as little-endian unsigned 32-bit integers, memoised in two generations: when the young one
        is full it becomes the old one, and what is still in use comes back from there."""
        found = self.older.get(piece)
        if found is None:
            ids = self.walk(piece.encode())
            found = self.pack[len(ids)](*ids) if len(ids) < 9 else np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            if len(self.pieces) >= self.size:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = found
        return found

    def forget(self) -> None:
        """Empties the memos: a Python worker that lives on keeps the vocabulary's tables only."""
        self.pieces, self.older, self.pairs = {}, {}, {}

    def encode(self, text: str, pattern) -> Iterator[bytes]:
        """Packed ids of ``text``, by blocks of pieces."""
        found = map(regex.Match.group, pattern.finditer(text)) if len(text) > 1 << 20 else iter(pattern.findall(text))
        packed = self.packed
        while block := list(islice(found, 1 << 16)):
            get = self.pieces.get
            yield b"".join([get(p) or packed(p) for p in block])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(docs: DataFrame, path: str, pattern: str, keep: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also
    token_ids array<int>; the columns of ``docs`` in ``carry`` follow.

    Null text counts as empty: 0 tokens and the digests of no bytes. doc_id may be null or repeat; rows map one to
    one. Special strings are ordinary text. Whole texts are encoded, long ones in blocks of pieces. Other columns of
    ``docs`` are ignored; no rows give none. No shuffle; the vocabulary's tables are built once per Python worker from
    ``path``, its memos end with each partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, compiled = encoder(path), regex.compile(pattern)
        for batch in small(batches):
            rows: list[tuple] = []
            for x in batch.column("text"):
                n, ids, back, blocks = 0, hashlib.sha256(), hashlib.sha256(), []
                for block in own.encode(x.as_py() or "", compiled):
                    n += len(block) // 4
                    ids.update(block)
                    back.update(own.decode(block))
                    if keep:
                        blocks.append(block)
                rows.append((n, ids.hexdigest(), back.hexdigest(), blocks))
            cols = [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                cols.append(pa.array([np.frombuffer(b"".join(r[3]), "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())))
                names.append("token_ids")
            cols += [batch.column(c) for c in carry]
            names += carry
            yield pa.RecordBatch.from_arrays(cols, names=names)
        own.forget()

    schema = StructType([*StructType.fromDDL(SCHEMA + ", token_ids array<int>" * keep), *(docs.schema[c] for c in carry)])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", *(c for c in carry if c != "text")).mapInArrow(run, schema)
