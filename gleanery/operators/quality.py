"""Filters on reviews: language, length, letters, and why a review is turned away."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from gleanery.functions import text as T
from gleanery.sources.scratch import materialize

REASONS = ("empty", "non_ascii", "too_short", "few_letters")


def checks(text: Column, min_length: int = 20, min_letters: float = 0.5) -> dict[str, Column]:
    """Conditions under which a text fails, cheapest first; null counts as empty."""
    filled = F.coalesce(text, F.lit(""))
    return {
        "empty": filled == "",
        "non_ascii": ~T.is_english(text) & (filled != ""),
        "too_short": F.length(filled) < min_length,
        "few_letters": F.coalesce(T.letter_share(text) < min_letters, F.lit(True)),
    }


def first_reason(text: Column, **limits) -> Column:
    """The first check that a text fails; null if it passes all."""
    out = F.when(F.lit(False), F.lit(""))
    for name, failed in checks(text, **limits).items():
        out = out.when(failed, name)
    return out


def all_reasons(text: Column, **limits) -> Column:
    """Every check that a text fails; an empty text fails as ``empty`` alone."""
    found = checks(text, **limits)
    return F.when(found["empty"], F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items() if n != "empty"])))


def english_reviews(df: DataFrame, column: str = "review_text") -> DataFrame:
    return df.where(T.is_english(F.col(column)))


def valid_reviews(df: DataFrame, column: str = "review_text", language_score: Column | Callable[[DataFrame], DataFrame] | None = None, least: float = 0.8, **limits) -> DataFrame:
    """Rows that pass all checks. ``language_score`` is a column, which may be a UDF, or a function that gives the rows it gets a column ``p_en``; it is
    only asked of rows that pass the native checks."""
    passed = df.where(first_reason(F.col(column), **limits).isNull())
    if language_score is None:
        return passed
    rows, score = (passed, language_score) if isinstance(language_score, Column) else (language_score(passed), F.col("p_en"))
    return rows.where(F.coalesce(score >= least, F.lit(False)))


def english_counts(df: DataFrame, column: str = "review_text") -> DataFrame:
    kept = F.count_if(T.is_english(F.col(column)))
    return df.agg(kept.alias("kept"), (F.count("*") - kept).alias("dropped"))


def funnel(df: DataFrame, column: str = "review_text", language_score: Callable[[DataFrame], DataFrame] | None = None, least: float = 0.8, **limits) -> DataFrame:
    """Rows and their share by first failing check; ``valid`` for those that pass. With a ``language_score`` (see ``valid_reviews``) the last check is the language:
    rows that pass the others but score under ``least`` for English fail as ``not_english``."""
    staged = df.withColumn("stage", first_reason(F.col(column), **limits))
    counts = staged.groupBy("stage").agg(F.count("*").alias("n"))
    if language_score is not None:
        english = F.coalesce(F.col("p_en") >= least, F.lit(False))
        asked = language_score(staged.where("stage is null")).select(F.when(~english, "not_english").alias("stage"))
        counts = counts.where("stage is not null").unionByName(asked.groupBy("stage").agg(F.count("*").alias("n")))
    counts = counts.withColumn("stage", F.coalesce("stage", F.lit("valid")))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("stage", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def gram_counts(df: DataFrame, text: str, label: str, n: int, most: int = 1 << 17) -> DataFrame:
    """(language, gram, c): lower-case character n-grams of texts and labels without nulls (a shorter text is one gram). Each task adds up what it reads
    before the shuffle and lets go of its counts beyond ``most`` grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def let_go() -> pa.RecordBatch:
            rows = [(k, g.lower(), c) for k, own in held.items() for g, c in own.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["language", "gram", "c"])

        for batch in batches:
            for k, x in zip(batch.column(label), batch.column(text)):
                t, own = x.as_py(), held.setdefault(k.as_py(), Counter())
                before = len(own)
                own.update(t[i : i + n] for i in range(max(len(t) - n + 1, 1)))
                size += len(own) - before
                if size > most:
                    yield let_go()
                    held, size = {}, 0
        yield let_go()

    counted = df.select(label, text).mapInArrow(run, "language string, gram string, c long")
    return counted.groupBy("language", "gram").agg(F.sum("c").alias("c"))


def language_profiles(df: DataFrame, text: str = "review_text", label: str = "language", n: int = 3, top: int = 300) -> DataFrame:
    """(language, gram, logp): the ``top`` commonest character n-grams of each language with smoothed log shares, and one row with gram null for any other gram."""
    from pyspark.sql import Window

    # written once: totals and ranks read it, and texts should not be cut as often
    counts = materialize(gram_counts(df.where(F.col(text).isNotNull() & F.col(label).isNotNull()), text, label, n))
    totals = counts.groupBy("language").agg(F.sum("c").alias("total"))
    best = Window.partitionBy("language").orderBy(F.desc("c"), "gram")
    kept = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).join(totals, "language")
    known = kept.select("language", "gram", F.log((F.col("c") + 1) / (F.col("total") + top)).alias("logp"))
    return known.unionByName(totals.select("language", F.lit(None).cast("string").alias("gram"), F.log(F.lit(1.0) / (F.col("total") + top)).alias("logp")))


def language_scores(df: DataFrame, profiles: DataFrame, key: str = "review_id", text: str = "review_text", n: int = 3) -> DataFrame:
    """(key, language, p): naive Bayes posterior of each profile's language for every row of ``n`` characters or more; ``score_column`` as rows."""
    langs = _shipped(profiles)[0]
    scored = score_column(df.where(F.length(text) >= n), profiles, text, n)
    return scored.select(key, F.posexplode("p_languages").alias("__i", "p")).withColumn("language", F.get(F.array(*map(F.lit, langs)).cast("array<string>"), F.col("__i"))).select(key, "language", "p")


def _shipped(profiles: DataFrame) -> tuple[list[str], list[float], dict[str, list[float]]]:
    """Languages, the log share of an unknown gram of each, and the gain of each known gram over it: a few hundred grams a language."""
    rows = profiles.collect()
    langs = sorted(r.language for r in rows if r.gram is None)
    floor = {r.language: r.logp for r in rows if r.gram is None}
    gains: dict[str, list[float]] = {}
    for r in rows:
        if r.gram is not None:
            gains.setdefault(r.gram, [0.0] * len(langs))[langs.index(r.language)] = r.logp - floor[r.language]
    return langs, [floor[k] for k in langs], gains


class _Ranks(dict):
    """The row of each gram, upper case or not, in a table of known grams."""

    def __init__(self, places: dict[str, int]) -> None:
        super().__init__()
        self.places = places

    def __missing__(self, gram: str) -> int:
        self[gram] = place = self.places.get(gram.lower(), len(self.places))
        return place


def score_column(df: DataFrame, profiles: DataFrame, text: str = "review_text", n: int = 3) -> DataFrame:
    """``df`` with ``p_languages`` (posteriors in order of the languages' names) and ``p_en``; null for texts under ``n`` characters and without profiles. Each text is
    scored where it lies: no row for a gram, no shuffle."""
    langs, floors, gains = _shipped(profiles)
    # the last row is that of any other gram
    table = np.array([*gains.values(), [0.0] * len(langs)])
    shipped = df.sparkSession.sparkContext.broadcast((np.array(floors), {g: k for k, g in enumerate(gains)}, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, places, gain = shipped.value
        rank = _Ranks(places)
        for batch in batches:
            out = []
            for x in batch.column(text):
                t = x.as_py()
                if t is None or len(t) < n or not len(floor):
                    out.append(None)
                    continue
                if len(rank) > 1 << 18:
                    rank.clear()
                at = np.fromiter((rank[t[i : i + n]] for i in range(len(t) - n + 1)), np.int64, len(t) - n + 1)
                s = len(at) * floor + np.bincount(at, minlength=len(gain)) @ gain
                e = np.exp(s - s.max())
                out.append(e / e.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, "p_languages"])

    scored = df.mapInArrow(run, StructType([*df.schema.fields, StructField("p_languages", ArrayType(DoubleType()))]))
    return scored.withColumn("p_en", F.get("p_languages", F.lit(langs.index("en"))) if "en" in langs else F.lit(None).cast("double"))


def english_score(profiles: DataFrame, text: str = "review_text") -> Callable[[DataFrame], DataFrame]:
    """What ``valid_reviews`` and ``funnel`` ask: rows with ``p_en`` by ``profiles``."""
    return lambda rows: score_column(rows, profiles, text).drop("p_languages")
