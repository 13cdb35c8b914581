"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its hashed signs: words in lower case, their stems (first 3 to 8 bytes, so that inflected and
compound forms of one word share a sign), pairs of neighbours and pairs with one or two words between. The regression learns
online with a rate of its own for each sign; its L1 term leaves most weights at exactly zero, so the model that is
shipped to the tasks is a short list of indexes and weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import U64, mix, small

BITS = 20
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
STEMS = range(3, 9)
GAPS = range(1, 4)
BLOCK = 1 << 20
#: What isn't a letter, digit or apostrophe ends a word; bytes beyond ASCII belong to words.
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() or b == 39 else 32 for b in range(256))
_FACTORS = mix(np.arange(50_001, 50_001 + 4096, dtype=U64)) | U64(1)
_KINDS = mix(np.arange(90_001, 90_033, dtype=U64)) | U64(1)


def signs(text: str | None) -> Iterator[np.ndarray]:
    """Indexes of the signs of a text, repeats included, in blocks of about BLOCK bytes that end with a word; pairs cross blocks.

    The hash of a word is a sum over its bytes, so those of its stems are differences of running sums."""
    data = (text or "").lower().encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    at, before = 0, np.empty(0, U64)
    while at < len(data):
        stop = data.find(b" ", at + BLOCK)
        stop = len(data) if stop < 0 else stop
        buf = np.frombuffer(data, np.uint8, stop - at, at)
        at = stop
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = buf != 32
        edges = np.diff(inside)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if not len(starts):
            continue
        sizes = ends - starts
        first = np.concatenate([[0], starts])
        place = np.arange(len(buf)) - np.repeat(first, np.diff(np.append(first, len(buf))))
        sums = np.zeros(len(buf) + 1, U64)
        np.cumsum((buf.astype(U64) + U64(1)) * _FACTORS[np.minimum(place, len(_FACTORS) - 1)], out=sums[1:])
        words = sums[ends] - sums[starts]
        out = [words * _KINDS[0]]
        for k in STEMS:
            s = starts[sizes >= k]
            out.append((sums[s + k] - sums[s]) * _KINDS[k])
        line = np.concatenate([before, words])
        for g in GAPS:
            new = line[max(0, len(before) - g) :]  # pairs whose later word is in this block
            if len(new) > g:
                out.append(new[:-g] * _KINDS[9 + g] + new[g:] * _KINDS[20 + g])
        before = line[-max(GAPS) :]
        yield (np.concatenate(out) >> U64(64 - BITS)).astype(np.int32)


def distinct_signs(text: str | None) -> np.ndarray:
    found = [np.unique(block) for block in signs(text)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


@dataclass
class Model:
    """Indexes and weights of the signs that kept a weight, and the bias; ``fitted`` is false if there was nothing to learn from."""

    places: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0, np.float32))
    bias: float = 0.0
    fitted: bool = False

    def scorer(self):
        """A function from text to score: the weights of the text's distinct signs, summed."""
        slot = np.zeros(1 << BITS, np.int32)  # 0: no weight
        slot[self.places] = np.arange(1, len(self.places) + 1)
        weights = np.concatenate([[0.0], self.weights])

        def score(text: str | None) -> float:
            if not self.fitted:
                return 0.0
            hits = [h[h > 0] for h in (slot[block] for block in signs(text))]
            total = self.bias + (float(weights[np.unique(np.concatenate(hits))].sum()) if hits else 0.0)
            return float(1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0))))

        return score


def ftrl(rows: list[tuple[np.ndarray, int]], alpha: float = 0.5, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, passes: int = 3) -> Model:
    """FTRL-proximal over (distinct signs, label) in the order given. Each weight follows from its z (gradients less what the
    changing rate owes to the weight) and n (squared gradients): zero while \\|z\\| <= l1. The bias has neither penalty."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS

    def weights(at: np.ndarray) -> np.ndarray:
        own, free = z[at], at == bias
        shrunk = np.where(free, own, np.sign(own) * np.maximum(np.abs(own) - l1, 0.0))
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + np.where(free, 0.0, l2))

    for _ in range(passes):
        for found, label in rows:
            at = np.append(found, bias)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(bias + 1))
    kept = np.flatnonzero(w[:-1])
    return Model(kept.astype(np.int32), w[kept].astype(np.float32), float(w[-1]), bool(rows))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def _dice(*cols) -> Column:
    return F.pmod(F.xxhash64(F.lit("toxicity sample"), *cols), F.lit(1 << 30)) / float(1 << 30)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        found = [distinct_signs(x.as_py()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["place", "toxic", "signs"])


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, most_chars: int = 30_000_000, **rates) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), rows that are held out left out.

    Fitted on the driver from a sample of about ``most_rows`` labels and, of their documents, about ``most_chars`` characters:
    the hash of a row decides, neither its partition nor its order. Labels other than 0 and 1, null ids and null texts are left out; repeated rows count once; a
    document with both labels counts once with each. The sampled labels are few enough to be broadcast to the texts."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    n = usable.count()
    if not n:
        return Model()
    picked = usable.where(_dice("doc_id") < min(1.0, most_rows / n)).distinct()
    rows = docs.where("text is not null").select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(F.broadcast(picked.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    keyed = rows.select("toxic", "text", F.xxhash64("doc_id", "text").alias("place"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    keyed = keyed.where(_dice("place") < min(1.0, most_chars / max(chars, 1))).dropDuplicates(["place", "toxic"])
    got = keyed.mapInArrow(_sparse, "place long, toxic int, signs array<int>").toArrow().sort_by([("place", "ascending"), ("toxic", "ascending")])
    return ftrl([(s.values.to_numpy(), y) for s, y in zip(got["signs"], got["toxic"].to_pylist())], **rates)


def predict(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out (crc32(doc_id as text) mod 4 is 2; null for a null id), score, predicted (1 from ``threshold`` on).

    Whole texts are scored, very long ones in blocks. A null or empty text, or one without a word, has the bias alone; a model fitted on nothing gives 0. Equal texts get
    equal scores and rows map one to one, repeated ones too; no rows give none. Other columns aren't read. No shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shipped.value.scorer()
        for batch in small(batches):
            scores = np.array([score(x.as_py()) for x in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """``predict`` with a model fitted by ``train`` on the rows that aren't held out."""
    return predict(docs, train(docs, labels, **bounds))
