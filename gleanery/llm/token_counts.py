"""Token counts of a word-end BPE vocabulary, by the whole-token shortcut.

Most words of running text are one token. Which vocabulary strings are (merging the string alone gives that one
token) is proven once on the driver; a task then counts a pre-token found in that set as 1 without merging it and
merges only the rest. A bounded memo keeps what the rest gave.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gleanery.llm.common import small

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Up to here every code point is long assigned and its own NFC form, so that the ``regex`` module and the library split alike; texts with others are split by the library.
PLAIN = 0x250
_ODD = regex.compile(rf"[^\x00-\u{PLAIN - 1:04x}]")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tok = Tokenizer.from_file(path)
    split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    specials = [x["content"] for x in spec["added_tokens"]]
    pattern = regex.compile(split["pattern"]["Regex"])
    marks = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
    return tok, pattern, marks, spec["model"]["end_of_word_suffix"] or "", spec["model"]["vocab"]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()


def whole_tokens(path: str) -> frozenset[str]:
    """Byte-level spellings (word end cut off) that the merges turn into one token. Bounded by the vocabulary."""
    tok, _, _, end, vocab = _tokenizer(path)
    heads = (v[: -len(end)] for v in vocab if end and v.endswith(end) and len(v) > len(end))
    return frozenset(h for h in heads if len(tok.model.tokenize(h)) == 1)


def _count(text: str, tok, pattern, marks, memo: dict[str, int], whole: frozenset[str], bound: int) -> int:
    def merged(piece: str) -> int:
        spelled = piece.encode().decode("latin-1").translate(LETTERS)
        n = 1 if spelled in whole else len(tok.model.tokenize(spelled))
        if len(memo) >= bound:
            memo.clear()
        if len(piece) <= 64:
            memo[piece] = n
        return n

    total = at = 0
    spans = [(m.start(), m.end()) for m in marks.finditer(text)] if marks and "<|" in text else []
    for start, stop in [*spans, (len(text), len(text))]:
        part, at = text[at:start], stop
        if _ODD.search(part):
            pieces = tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(part))
            total += sum(1 if p in whole else len(tok.model.tokenize(p)) for p, _ in pieces)
        elif part:
            found = map(regex.Match.group, pattern.finditer(part.lower())) if len(part) > 1 << 20 else iter(pattern.findall(part.lower()))
            get = memo.get
            while block := list(islice(found, 1 << 16)):
                total += sum([get(p) or merged(p) for p in block])
    return total + len(spans)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, memo_entries: int = 200_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty: 0 bytes, 0 tokens. doc_id may be null or repeat; rows map one to one. Strings that
    spell added tokens count as that one token, as the library does by default. Whole texts are counted, long ones in
    blocks of pieces. Other columns of ``docs`` are ignored; no rows give none. No shuffle; the memo of merged pieces, at most
    ``memo_entries`` of up to 64 characters, ends with the partition.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, pattern, marks, _, _ = _tokenizer(path)
        known, memo = whole.value, {}
        for batch in small(batches):
            sizes, counts = [], []
            for x in batch.column("text"):
                text = x.as_py() or ""
                sizes.append(len(text.encode()))
                counts.append(_count(text, tok, pattern, marks, memo, known, memo_entries))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
