"""Sub-word tokens of a fixed length: greedy longest match over a given vocabulary, ids and attention mask.

The vocabulary is a parameter (its file, or its pieces in order of their ids) and goes to the tasks once; nothing is trained. Words
are cut by themselves, so a task remembers a bounded number of cut words.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD, UNKNOWN, START, END = SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")
CONTINUED = "##"
LONGEST_WORD = 100
#: A word is a run without white space, control and punctuation; every punctuation mark (ASCII symbols included) and every ideograph is a word of its own.
_WORDS = regex.compile(r"[\p{P}$+<=>^`|~\p{Han}]|[^\s\p{P}$+<=>^`|~\p{Han}\p{Cc}]+")


def vocabulary_from(path: str) -> list[str]:
    """Pieces of a byte-level vocabulary file whose words start with a marked space: word starts as they are, all others as
    continuations, in the order of their ids after the special tokens; only printable lower-case ASCII ones, as the cutting is of lower-case text."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    pieces = [p[1:] if p[0] == "Ġ" else CONTINUED + p for p in sorted(vocab, key=vocab.__getitem__)]
    plain = [p for p in pieces if p and p not in (CONTINUED,) and p.isascii() and p.isprintable() and p == p.lower()]
    letters = [chr(c) for c in range(33, 127) if not 65 <= c <= 90]
    return list(dict.fromkeys([*SPECIAL, *letters, *(CONTINUED + c for c in letters), *plain]))


def words(text: str) -> list[str]:
    """Lower-case words of a text without accents."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return _WORDS.findall(bare)


def cut(word: str, ids: dict[str, int], longest: int) -> list[int]:
    """Ids of the longest pieces from the left; one unknown for a word that can't be cut or has over LONGEST_WORD characters."""
    out, at = [], 0
    while at < len(word) <= LONGEST_WORD:
        lead = CONTINUED if at else ""
        for stop in range(min(len(word), at + longest), at, -1):
            if (found := ids.get(lead + word[at:stop])) is not None:
                out.append(found)
                at = stop
                break
        else:
            return [ids[UNKNOWN]]
    return out or [ids[UNKNOWN]]


def encode(docs: DataFrame, vocabulary: list[str], size: int | None = 128, text: str = "review_text", key: str = "review_id", memo: int = 100_000) -> DataFrame:
    """(key, input_ids, attention_mask, n_pieces) for every row of ``docs``: start mark, pieces, end mark, cut and padded to ``size`` (None: all pieces, no padding).

    n_pieces counts the pieces of the whole text. Null texts are empty. Keys may be null or repeat. No rows give none. No shuffle."""
    missing = [s for s in SPECIAL if s not in vocabulary]
    if missing or size is not None and size < 2:
        raise ValueError(f"the vocabulary lacks {missing}" if missing else "size must hold both marks")
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {p: i for i, p in enumerate(shipped.value)}
        longest, known = max(map(len, ids)), {}
        pad, start, end = ids[PAD], ids[START], ids[END]
        for batch in batches:
            rows, masks, counts = [], [], []
            for x in batch.column("text"):
                pieces = []
                for word in words(x.as_py() or ""):
                    found = known.get(word)
                    if found is None:
                        if len(known) >= memo:
                            known.clear()
                        found = known[word] = cut(word, ids, longest)
                    pieces += found
                kept = pieces if size is None else pieces[: size - 2]
                row = [start, *kept, end]
                gap = 0 if size is None else size - len(row)
                rows.append(row + [pad] * gap)
                masks.append([1] * len(row) + [0] * gap)
                counts.append(len(pieces))
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int8()), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, k) for c, k in zip((rows, masks, counts), kinds))], names=["key", "input_ids", "attention_mask", "n_pieces"])

    schema = f"key {dict(docs.dtypes)[key]}, input_ids array<int>, attention_mask array<tinyint>, n_pieces long"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def pieces_of(encoded: DataFrame, vocabulary: list[str], key: str = "review_id") -> DataFrame:
    """(key, pos, token): pieces by place, marks and padding included where the mask is 1. The vocabulary is joined by a broadcast of its own size."""
    spark = encoded.sparkSession
    names = spark.createDataFrame(list(enumerate(vocabulary)), "piece int, token string")
    rows = encoded.select(key, F.posexplode(F.arrays_zip("input_ids", "attention_mask")).alias("pos", "p")).where("p.attention_mask = 1")
    return rows.select(key, "pos", F.col("p.input_ids").alias("piece")).join(F.broadcast(names), "piece").select(key, "pos", "token")
