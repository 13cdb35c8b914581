"""Mixing documents to target weights by iterative proportional fitting.

Tokens are summed by (source, language, topic), with each source and language that has no target of its own under
``other``: the cells are at most as many as the targets' product, whatever the corpus holds, and only they come to the
driver. Raking scales the cells to each marginal in turn until all three fit; a cell can't give more tokens than it has, so
one that reaches its total stays there and the rest makes up for it. Cell weight over cell tokens is the probability with
which each of its documents is drawn; the draw compares it with a hash of doc_id, so the same documents come whatever
the partitions. The texts are read once for the cells and never shuffled.

Topics are clusters of term vectors within a language (k-means of hashed, weighted word counts of all its documents): ``en:0`` to
``en:3`` and so on. Each round is a pass over the counts, whose sums by language and topic are made in the tasks. Vectors and centres are
rounded to ``GRID``, so sums and scores are exact and no order of rows changes them. Unless targets say otherwise, a language's weight is shared equally among its topics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.llm.common import materialize, small, word_hashes, words_of

OTHER, AXES = "other", ("source", "lang", "topic")
DEFAULT_TARGETS = {
    # a value that isn't listed falls under ``other``; shares are scaled to sum to 1 over what the corpus has
    "source": {**{f"src{i}": 1.0 for i in range(20)}, OTHER: 1.0},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15, OTHER: 0.02},
}
#: Places of a term vector.
DIM = 256
#: Steps of a unit; products of two vectors in such steps are whole numbers below 2^53.
GRID = float(1 << 20)


def term_counts(text: str | None) -> tuple[int, np.ndarray]:
    """Words of a text, and how many of those of four bytes or more, in lower case, fall on each place."""
    words = words_of((text or "").lower())
    long = [w for w in words if len(w) > 3]
    return len(words), np.bincount((word_hashes(long) >> np.uint64(56)).astype(np.int64), minlength=DIM) if long else np.zeros(DIM, np.int64)


@dataclass
class Topics:
    """``weight``: of each place. ``centres``: unit vectors of the topics of each language."""

    weight: dict[str, np.ndarray]
    centres: dict[str, np.ndarray]

    def of(self, lang: str, counts: np.ndarray) -> int:
        """The topic whose centre is nearest by angle; ties, and texts without long words, go to the first."""
        return int((self.centres[lang] @ (np.log1p(counts) * self.weight[lang])).argmax()) if lang in self.centres else 0


def fit_topics(samples: dict[str, np.ndarray], topics: int, per_topic: int = 50, rounds: int = 10) -> Topics:
    """Spherical k-means of each language's sampled counts, from rows spread evenly over the sample; no more topics than one for ``per_topic`` sampled documents."""
    found = Topics({}, {})
    for lang, counts in sorted(samples.items()):
        counts = counts[counts.sum(axis=1) > 0]
        if not len(counts):
            continue
        weight = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1
        x = np.log1p(counts) * weight
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        x = np.unique(x, axis=0)
        centres = x[np.linspace(0, len(x) - 1, max(1, min(topics, len(counts) // per_topic, len(x)))).astype(int)].copy()
        for _ in range(rounds):
            at = (x @ centres.T).argmax(axis=1)
            for c in range(len(centres)):
                if (mean := x[at == c].sum(axis=0)).any():
                    centres[c] = mean / np.sqrt(mean @ mean)
        found.weight[lang], found.centres[lang] = weight, centres
    return found


def sample_counts(own: DataFrame, rows: int) -> dict[str, np.ndarray]:
    """Term counts of about ``rows`` documents of each ``lang_group`` of ``own`` (doc_id, lang_group, text), chosen by hashed doc_id."""
    sizes = {r.lang_group: r.n for r in own.groupBy("lang_group").agg(F.count("*").alias("n")).collect()}  # a row for each target
    if not sizes:
        return {}
    rate = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, rows / n)])[F.col("lang_group")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            counts = [term_counts(x.as_py())[1] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang_group"), pa.array(counts, pa.list_(pa.int64()))], names=["lang_group", "counts"])

    dice = F.pmod(F.xxhash64(F.lit("topic sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    got = own.where(dice < rate).select("lang_group", "text").mapInArrow(run, "lang_group string, counts array<long>").toArrow()
    held: dict[str, list[bytes]] = {}
    for lang, counts in zip(got["lang_group"].to_pylist(), got["counts"].to_pylist()):
        held.setdefault(lang, []).append(counts)
    return {k: np.array(sorted(v), np.int64) for k, v in held.items()}


def _sums(counted: DataFrame, add) -> dict[tuple[str, int], np.ndarray]:
    """``add`` gives rows of whole numbers by topic for the count matrix of a language; their sums by (lang_group, topic) over all of ``counted``: a row for each topic of a target."""
    schema = "lang_group string, topic int, sums array<long>"
    kinds = pa.schema([("lang_group", pa.string()), ("topic", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def table(held: dict[tuple[str, int], np.ndarray]) -> pa.Table:
        return pa.table([pa.array([k for k, _ in held], pa.string()), pa.array([t for _, t in held], pa.int32()), pa.array(list(held.values()), pa.list_(pa.int64()))], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in small(batches, 4 << 20):
            langs, counts = np.array(batch.column("lang_group").to_pylist(), object), batch.column("counts").flatten().to_numpy().reshape(-1, DIM)
            some = counts.any(axis=1)
            for lang in set(langs[some]):
                for topic, row in add(lang, counts[some & (langs == lang)]):
                    held[lang, topic] = held[lang, topic] + row if (lang, topic) in held else row
        yield from table(held).to_batches()

    def total(own: pa.Table) -> pa.Table:
        rows = own["sums"].combine_chunks().flatten().to_numpy().reshape(own.num_rows, -1).sum(axis=0)
        return table({(own["lang_group"][0].as_py(), own["topic"][0].as_py()): rows})

    got = counted.select("lang_group", "counts").mapInArrow(run, schema).groupBy("lang_group", "topic").applyInArrow(total, schema).toArrow()
    return {(k, t): np.array(x, np.int64) for k, t, x in zip(got["lang_group"].to_pylist(), got["topic"].to_pylist(), got["sums"].to_pylist())}


def _on_grid(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1, in whole steps."""
    return np.rint(rows / np.sqrt((rows * rows).sum(axis=1))[:, None] * GRID)


def fit_all(counted: DataFrame, topics: int, per_topic: int = 50, rounds: int = 10) -> Topics:
    """Spherical k-means over all rows of ``counted`` (lang_group, counts); no more topics of a language than one for ``per_topic`` of its documents.

    The first centres are the means of the documents whose largest entry, among the places that differ most between documents, is the same."""
    found, leads = Topics({}, {}), {}
    seen = _sums(counted, lambda _, counts: [(0, np.concatenate([[len(counts)], (counts > 0).sum(axis=0)]))])
    for (lang, _), row in sorted(seen.items()):
        n, df = int(row[0]), row[1:]
        found.weight[lang] = weight = np.log((1 + n) / (1 + df)) + 0.1
        leads[lang] = np.sort(np.argsort(-(df * (n - df) * weight**2), kind="stable")[: max(1, min(topics, n // per_topic))])

    def step(choose):
        def add(lang: str, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            x = _on_grid(np.log1p(counts) * found.weight[lang])
            at = choose(lang, x)
            for topic in np.unique(at):
                yield int(topic), x[at == topic].sum(axis=0).astype(np.int64)

        return _sums(counted, add)

    sums = step(lambda lang, x: x[:, leads[lang]].argmax(axis=1))
    grid = {lang: np.stack([_on_grid(sums[k][None].astype(float))[0] for k in sorted(sums) if k[0] == lang]) for lang in leads}
    for _ in range(rounds):
        now = grid
        sums = step(lambda lang, x, now=now: (x @ now[lang].T).argmax(axis=1))
        grid = {lang: np.stack([_on_grid(sums[lang, t][None].astype(float))[0] if (lang, t) in sums else c for t, c in enumerate(cs)]) for lang, cs in now.items()}
        if all((grid[lang] == now[lang]).all() for lang in grid):
            break
    found.centres = {lang: cs / np.sqrt((cs * cs).sum(axis=1))[:, None] for lang, cs in grid.items()}
    return found


def _count(carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            read = [term_counts(text.as_py()) for text in batch.column("text")]
            counts = pa.array(np.concatenate([c for _, c in read]).astype(np.int32))
            columns = [pa.array([max(1, n) for n, _ in read], pa.int64()), pa.ListArray.from_arrays(np.arange(len(read) + 1, dtype=np.int32) * DIM, counts)]
            kept = ["doc_id", "source_group", "lang_group", *carry]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in kept)], names=["tokens", "counts", *kept])

    return run


def _topics(model: Topics) -> Column:
    """Names of the topics of (lang_group, counts)."""

    @F.arrow_udf("string")
    def name(langs: pa.Array, counts: pa.Array) -> pa.Array:
        rows = counts.flatten().to_numpy().reshape(-1, DIM)
        return pa.array([f"{lang}:{model.of(lang, own)}" for lang, own in zip(langs.to_pylist(), rows)], pa.string())

    return name("lang_group", "counts")


@dataclass
class Mix:
    """``probability``: of each cell (source, lang, topic), all under their target names."""

    probability: dict[tuple[str, str, str], float]
    weight: dict[tuple[str, str, str], float]
    error: float


def filled(share: np.ndarray, budget: float, available: np.ndarray) -> np.ndarray:
    """``budget`` by ``share``; a value that has less than its part gives all it has, and the others take the rest in proportion."""
    goal, open_ = np.zeros(len(share)), share > 0
    while open_.any():
        want = np.where(open_, share / share[open_].sum() * (budget - goal[~open_].sum()), 0)
        over = open_ & (want >= available)
        if not over.any():
            return np.where(open_, want, goal)
        goal, open_ = np.where(over, available, goal), open_ & ~over
    return goal


def rake(cells: dict[tuple[str, str, str], int], targets: dict[str, dict[str, float]], fraction: float, rounds: int = 1000, tolerance: float = 1e-9) -> Mix:
    """Weights of cells (tokens by key) that meet the marginals of ``targets`` and sum to ``fraction`` of all tokens, none above its tokens.

    A value with fewer tokens than its part gives all it has, and the others take the rest in proportion. ``error`` is the
    largest gap between a marginal's share and its target (of the values that have tokens), where the tokens allow no exact solution.
    """
    keys = sorted(k for k, n in cells.items() if n > 0)
    if not keys:
        return Mix({}, {}, 0.0)
    have = np.array([cells[k] for k in keys], float)
    budget = fraction * have.sum()
    groups, asked = [], []
    for axis, name in enumerate(AXES):
        values = sorted({k[axis] for k in keys})
        share = np.array([max(0.0, targets[name].get(v, 0.0)) for v in values])
        share = share / share.sum() if share.sum() > 0 else np.full(len(values), 1 / len(values))
        at = np.array([values.index(k[axis]) for k in keys])
        groups.append((at, filled(share, budget, np.bincount(at, have, len(values)))))
        asked.append(share * budget)
    mass = have * fraction
    for _ in range(rounds):
        last = mass
        for at, goal in groups:
            # scale what isn't at its cap to what the capped cells leave of the goal; new caps call for another look
            for _ in range(len(keys)):
                capped = mass >= have * (1 - 1e-12)
                fixed = np.bincount(at, np.where(capped, have, 0), len(goal))
                open_ = np.bincount(at, np.where(capped, 0, mass), len(goal))
                total = fixed + open_
                factor = np.divide(np.maximum(0, goal - fixed), open_, out=np.ones_like(goal), where=open_ > 0)
                over = fixed > goal  # caps alone are too much: they come down too
                factor = np.where(over, np.divide(goal, total, out=np.ones_like(goal), where=total > 0), factor)
                new = np.where(capped & ~over[at], have, mass * factor[at])
                again = (new > have * (1 + 1e-12)).any()
                mass = np.minimum(new, have)
                if not again:
                    break
        if np.abs(mass - last).max() <= tolerance * budget:
            break
    gap = max(float(np.abs(np.bincount(at, mass, len(goal)) - goal).max()) / budget if budget else 0.0 for (at, _), goal in zip(groups, asked))
    return Mix({k: float(min(1.0, m / n)) for k, m, n in zip(keys, mass, have)}, {k: float(m) for k, m in zip(keys, mass)}, gap)


def under(value: Column, names: dict[str, float]) -> Column:
    return F.when(value.isin(*names), value).otherwise(F.lit(OTHER))


def mix(
    docs: DataFrame, targets: dict[str, dict[str, float]] = DEFAULT_TARGETS, fraction: float = 0.5, seed: int = 7, tokens: Column | None = None, topic: Column | None = None,
    topics: int = 4, sample: int | None = None, per_topic: int = 50, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source, lang): doc_id, source_group, lang_group, topic, tokens, probability, kept, error, and the columns of ``docs`` in ``carry``.

    Null or unlisted sources and languages are ``other``. Null and empty texts count one token; whole texts count, however
    long. ``tokens`` and ``topic`` may be given as columns; topics without a target are then ``other``. Else topics are
    clusters fitted on all documents of each language group, ``per_topic`` of them or more for each; a caller that asks for a ``sample`` has them fitted on about that many of each. The expected tokens of each marginal are its share of ``fraction`` of all tokens as far as the
    cells have that many; ``error`` is the largest gap of a marginal's share that is left. Equal doc_ids are drawn alike; a null
    doc_id is drawn as one more id. Columns of the results' names in ``docs`` are not read; other columns are ignored; no rows give none.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        under(F.col("source"), targets["source"]).alias("source_group"),
        under(F.col("lang"), targets["lang"]).alias("lang_group"),
        "text",
        *([tokens.cast("long").alias("__tokens")] if tokens is not None else []),
        *([topic.alias("__topic")] if topic is not None else []),
        *(c for c in carry if c != "text"),
    )
    given = tuple(c for c in ("__tokens", "__topic") if c in own.columns)
    named = (*given, *(c for c in carry if c != "text"), *(["text"] if "text" in carry else []))
    kinds = StructType([*StructType.fromDDL("tokens long, counts array<int>, doc_id long, source_group string, lang_group string"), *(own.schema[c] for c in named)])
    # written once: the fit reads the counts, the cells are summed from it, and the draw reads it again
    counted = materialize(own.mapInArrow(_count(named), kinds))
    if topic is None:
        model = fit_all(counted, topics, per_topic) if sample is None else fit_topics(sample_counts(own, sample), topics, per_topic)
    read = counted if tokens is None else counted.withColumn("tokens", F.col("__tokens"))
    read = read.withColumn("topic", _topics(model) if topic is None else under(F.col("__topic"), targets["topic"]))
    axes = ["source_group", "lang_group", "topic"]
    own = read.select("doc_id", *axes, "tokens", *carry)
    cells = {tuple(r[a] for a in axes): r.n for r in own.groupBy(*axes).agg(F.sum("tokens").alias("n")).collect()}
    if "topic" not in targets:
        alike = {lang: {t for _, k, t in cells if k == lang} for lang in {k for _, k, _ in cells}}
        targets = targets | {"topic": {t: targets["lang"].get(lang, 0.0) / len(ts) for lang, ts in alike.items() for t in ts}}
    found = rake(cells, targets, fraction)
    spark = docs.sparkSession
    rates = spark.createDataFrame([(*k, p) for k, p in found.probability.items()], "source_group string, lang_group string, topic string, probability double")
    dice = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 52)) / float(1 << 52)
    # a row for each cell, no more than the targets' product
    out = own.join(F.broadcast(rates), axes, "left")
    return out.select("doc_id", *axes, "tokens", "probability", (dice < F.coalesce("probability", F.lit(0.0))).alias("kept"), F.lit(float(found.error)).alias("error"), *carry)
