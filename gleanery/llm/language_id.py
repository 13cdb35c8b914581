"""Language identification by hierarchical discrimination.

A document is a unit vector of hashed character 1- to 3-grams of its whole text. Linear support vector machines first
tell the language family (one against the rest); within the family one machine for each pair of languages votes. The
machines are fitted on the driver from a bounded sample of labelled rows: about ``per_language`` rows of each of the
``languages`` commonest labels, about ``most_rows`` in all. Their weights, bounded by DIM times the number of machines, are
shipped to the tasks that read the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.llm.common import small

DIM = 1 << 13
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, family string"
UNKNOWN = "und"
#: Families of languages by their ISO 639-1 code; a language outside this list is a family of its own.
FAMILIES = {
    **dict.fromkeys(("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("hi", "bn", "ur", "mr", "ne", "pa", "gu", "fa"), "indo-iranian"),
    **dict.fromkeys(("tr", "az", "kk", "uz", "ky"), "turkic"),
}
#: Letters are the Unicode categories L: number forms such as a half or a Roman eight are none.
_LETTER = regex.compile(r"\p{L}")
_GAPS = regex.compile(r"[^\p{L}\p{M}]+")
_BLOCK = 1 << 18


def has_letter(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


def features(text: str) -> np.ndarray:
    """The unit vector of a text: log-damped counts of hashed 1- to 3-grams over lower-case letters, runs of anything else as one space. Long texts are counted in blocks."""
    counts = np.zeros(DIM, np.int64)
    tail = "  "
    for at in range(0, len(text), _BLOCK):
        s = tail + _GAPS.sub(" ", text[at : at + _BLOCK].lower())
        s += " " if at + _BLOCK >= len(text) else ""
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for grams in (one[2:], two[1:], three):  # those that end after the tail
            counts += np.bincount(grams >> np.uint32(19), minlength=DIM)
        tail = s[-2:]
    x = np.log1p(counts).astype(np.float32)
    size = float(np.sqrt((x * x).sum()))
    return x / size if size else x


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 8.0, passes: int = 12) -> np.ndarray:
    """Weights (the last one is the bias) of a linear support vector machine with squared hinge loss, by coordinate
    descent on the dual problem; y is +1 or -1. Each class has the same total cost."""
    n = len(y)
    w, bias = np.zeros(x.shape[1], np.float64), 0.0
    alpha = np.zeros(n)
    share = {s: max(1, int((y == s).sum())) for s in (-1, 1)}
    ridge = np.array([share[int(s)] / n for s in y]) / cost
    norms = np.einsum("ij,ij->i", x, x).astype(np.float64) + 1.0 + ridge
    order = np.random.default_rng(0)
    for _ in range(passes):
        for i in order.permutation(n):
            step = (y[i] * (x[i] @ w + bias) - 1.0 + ridge[i] * alpha[i]) / norms[i]
            new = max(0.0, alpha[i] - step)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    return np.append(w, bias).astype(np.float32)


@dataclass
class Model:
    """``members``: languages of each family. ``weights``: a row for each machine; ``family_rows`` and ``pair_rows`` say which."""

    members: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM + 1), np.float32))
    family_rows: dict[str, int] = field(default_factory=dict)
    pair_rows: dict[tuple[str, str], int] = field(default_factory=dict)

    def decide(self, margins: np.ndarray) -> tuple[str, str, float]:
        """Language, family and score of one document: the product of the family's share and the votes' mean confidence.
        Ties: the family, then the language first by name; languages of equally many votes go by their confidence first."""
        sure = lambda m: 1.0 / (1.0 + np.exp(-4.0 * float(m)))
        shares = {f: sure(margins[r]) for f, r in self.family_rows.items()} or dict.fromkeys(self.members, 1.0)
        family = max(sorted(shares), key=shares.__getitem__)
        top = shares[family] / sum(shares.values()) if len(shares) > 1 else 1.0
        langs = self.members[family]
        votes, belief = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for (a, b), r in ((p, r) for p, r in self.pair_rows.items() if p[0] in votes):
            p = sure(margins[r])
            votes[a if p >= 0.5 else b] += 1
            belief[a] += p
            belief[b] += 1 - p
        best = max(sorted(langs), key=lambda k: (votes[k], belief[k]))
        within = belief[best] / (len(langs) - 1) if len(langs) > 1 else 1.0
        return best, family, min(1.0, max(0.0, top * within))


def fit(rows: list[tuple[str, np.ndarray]], families: dict[str, str]) -> Model:
    model, machines = Model(), []
    for lang in sorted({k for k, _ in rows}):
        model.members.setdefault(families.get(lang, lang), []).append(lang)
    if not rows:
        return model
    langs, x = np.array([k for k, _ in rows], object), np.stack([v for _, v in rows])
    own = np.array([families.get(k, k) for k in langs], object)
    if len(model.members) > 1:
        for f in sorted(model.members):
            model.family_rows[f] = len(machines)
            machines.append(fit_machine(x, np.where(own == f, 1, -1)))
    for members in model.members.values():
        for a, b in combinations(members, 2):
            model.pair_rows[a, b] = len(machines)
            pick = (langs == a) | (langs == b)
            machines.append(fit_machine(x[pick], np.where(langs[pick] == a, 1, -1)))
    if machines:
        model.weights = np.stack(machines)
    return model


def _sparse_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        langs, places, values = [], [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            if has_letter(t := text.as_py()):
                x = features(t)
                at = np.flatnonzero(x)
                langs.append(lang)
                places.append(at.astype(np.int32))
                values.append(x[at])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["lang", "places", "weights"])


def train(labelled: DataFrame, per_language: int = 400, families: dict[str, str] = FAMILIES, languages: int = 200, most_rows: int = 4000) -> Model:
    """A model from rows (doc_id, text, lang). Rows with null text or lang are left out, and so are labels beyond the ``languages``
    commonest (ties: by name). Of each language every row whose hashed doc_id falls under a rate is taken, the rate giving
    ``per_language`` rows in expectation, or an equal share of ``most_rows`` if that is less: which rows are taken depends
    on neither partitions nor order, and what comes to the driver is bounded."""
    usable = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    rates = {r.lang: min(per_language, most_rows / len(counts)) / r.n for r in counts}
    if not rates:
        return Model()
    rate = F.create_map(*[F.lit(v) for pair in rates.items() for v in pair])[F.col("lang")]
    dice = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    got = usable.where(dice < rate).select("lang", "text").mapInArrow(_sparse_features, "lang string, places array<int>, weights array<float>").toArrow()
    rows = []
    for lang, at, v in zip(got["lang"].to_pylist(), got["places"], got["weights"]):
        x = np.zeros(DIM, np.float32)
        x[at.values.to_numpy()] = v.values.to_numpy()
        rows.append((lang, x))
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))
    return fit(rows, families)


def remainder() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


def predict(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score, family, and the columns of ``docs`` in ``carry``.

    ``und`` with score 0 and family null if the text is null or has no letter, or if the model knows no language.
    Very long texts are counted whole, in blocks. held_out is true if crc32(doc_id as text) mod 5 is 0 and null for a null doc_id. Equal texts get equal answers; rows
    map one to one. Other columns of ``docs``, lang and source among them, aren't read. No shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        known, w, bias = bool(own.members), np.ascontiguousarray(own.weights[:, :-1].T), own.weights[:, -1]
        for batch in small(batches):
            out = []
            for x in batch.column("text"):
                text = x.as_py()
                out.append(own.decide(features(text) @ w + bias) if known and has_letter(text) else (UNKNOWN, None, 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([o[0] for o in out], pa.string()), pa.array([o[2] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.string()), *(batch.column(c) for c in carry)],
                names=["doc_id", "held_out", "lang_pred", "score", "family", *carry],
            )

    rest = [c for c in carry if c != "text"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder() == 0).alias("held_out"), "text", *rest).mapInArrow(run, StructType([*StructType.fromDDL(SCHEMA), *(docs.schema[c] for c in carry)]))


def identify(docs: DataFrame, per_language: int = 400, families: dict[str, str] = FAMILIES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``predict`` with a model fitted on the rows of ``docs`` (doc_id, text, lang) that aren't held out. Empty tables give empty results."""
    return predict(docs, train(docs.where(remainder() != 0), per_language, families), carry)
