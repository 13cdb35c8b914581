"""Quality rules by distribution divergence, in DataFrame operations only.

Each document becomes two histograms over its whole text: character classes and common words. The common words of a
language are learned: its most frequent words of letters over all of its documents. The language references are the same
histograms summed over all documents of a language. A document is kept if its Jensen-Shannon distances to the nearest
reference stay under thresholds; texts too short for a distance to mean anything are guarded by minimum lengths, and so are
references. Base rules on word count and repeated five-word windows come first.

Every language has a reference of its own. Those of the commonest languages are literals of the plan, against which each document
is held; a document of any other language is held against these and its own language's, which reaches it by a join on lang.
No such language has more than 1/(``languages`` + 1) of the rows, so that join has no hot key.

Words are counted by language in one pass over the texts, with a combine before the shuffle. A second pass writes
histograms and base counts to the shared folder; references are summed from there (a row for each language and bin), and the
verdict is a projection. Nothing is grouped by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import SPACES, materialize

#: Character classes in the order in which they are taken out of the text; what remains is the last bin.
CLASSES = [("lower", "[a-z]+"), ("space", f"[{SPACES}]+"), ("upper", "[A-Z]+"), ("symbol", "[#*$%&|<>]+"), ("letter", "\\p{L}+"), ("digit", "[0-9]+"), ("mark", "[.,;:!?'\"()\\-]+")]


def common_words(docs: DataFrame, per_language: int = 16, languages: int = 32, longest: int = 40) -> dict[str, list[str]]:
    """The ``per_language`` most frequent lower-case words of letters (``longest`` characters at most) of each of the ``languages`` commonest
    languages of ``docs`` (text, lang), over all of their documents; ties by name."""
    own = docs.where("lang is not null")
    langs = [r.lang for r in own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()]
    words = own.where(F.col("lang").isin(langs) & F.col("text").isNotNull()).select("lang", F.explode(F.split(F.lower("text"), f"[{SPACES}]+")).alias("w")).where(F.col("w").rlike("^\\p{L}+$") & (F.length("w") <= longest))
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("r") <= per_language)
    found = {k: [] for k in langs}
    for r in best.orderBy("lang", "r").collect():
        found[r.lang].append(r.w)
    return found


def histograms(docs: DataFrame, listed_words: list[str], *extra: str) -> DataFrame:
    """doc_id, base counts, ``chars`` and ``common`` (arrays of counts, the latter of ``listed_words``, which are sorted and distinct, and all others) for each row of
    ``docs``; ``extra`` columns are kept."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, F.coalesce("text", F.lit("")).alias("__t"))
    df = df.withColumn("__w", F.expr(f"filter(split(__t, r'[{SPACES}]+'), w -> w <> '')"))
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    # character classes: each is taken out of what the classes before it left
    rest, names = "__t", []
    for k, (name, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"__r{k}", F.regexp_replace(rest, pattern, ""))
        names.append((F.length(rest) - F.length(f"__r{k}")).cast("long").alias(name))
        rest = f"__r{k}"
    df = df.withColumn("chars", F.array(*names, F.length(rest).cast("long")))
    df = df.withColumn("word_chars", (F.length("__t") - F.col("chars")[1]).cast("long")).withColumn("n_symbols", F.col("chars")[3])
    lines = F.expr(f"filter(split(__t, '\n'), x -> x rlike r'[^{SPACES}]')")
    df = df.withColumn("__l", lines).withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    df = df.withColumn("__m", F.filter(F.transform("__w", F.lower), lambda w: w.isin(listed_words) if listed_words else F.lit(False)))
    # sorted among all listed words, each listed word ends a run that is one longer than its count
    df = df.withColumn("__o", F.sort_array(F.concat("__m", F.array(*map(F.lit, listed_words)).cast("array<string>"))))
    df = df.withColumn("__e", F.expr("filter(transform(__o, (w, i) -> if(w <=> get(__o, i + 1), null, i)), i -> i is not null)"))
    df = df.withColumn("common", F.concat(F.expr("transform(__e, (e, k) -> bigint(e - coalesce(get(__e, k - 1), -1) - 1))"), F.array(F.col("n_words") - F.size("__m"))))
    # words covered by five-word windows that the text holds more than once; positions are sorted out only where a window repeats
    df = df.withColumn("__h", F.expr("transform(__w, w -> xxhash64(w))"))
    df = df.withColumn("__k", F.expr("transform(sequence(0, greatest(int(n_words) - 5, 0)), i -> xxhash64(get(__h, i), get(__h, i + 1), get(__h, i + 2), get(__h, i + 3), get(__h, i + 4)))"))
    df = df.withColumn("__again", (F.col("n_words") > 5) & (F.size(F.array_distinct("__k")) < F.size("__k")))
    df = df.withColumn("__s", F.expr("if(__again, sort_array(transform(__k, (k, i) -> struct(k as k, i as i))), array())"))
    df = df.withColumn("__p", F.expr("sort_array(transform(filter(__s, (x, i) -> get(__s, i - 1).k <=> x.k or get(__s, i + 1).k <=> x.k), x -> x.i))"))
    df = df.withColumn("n_repeat_words", F.expr("aggregate(transform(__p, (p, i) -> least(5, coalesce(get(__p, i + 1) - p, 5))), 0L, (a, x) -> a + x)"))
    return df.select("doc_id", *extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common")


def references(counted: DataFrame, languages: list[str], least_words: int = 500) -> dict[str, tuple[list[float], list[float]]]:
    """Shares of both histograms for each of ``languages`` whose documents in ``counted`` (lang, n_words, chars, common) have ``least_words`` words or more.
    All rows count; the sums have one row for each language and bin, a bounded number."""
    own = counted.where(F.col("lang").isin(languages))
    sums = {}
    for name in ("chars", "common"):
        for r in own.select("lang", F.posexplode(name)).groupBy("lang", "pos").agg(F.sum("col").alias("n")).collect():
            sums.setdefault((r.lang, name), {})[r.pos] = r.n
    shares = lambda d: [d[i] / max(1, sum(d.values())) for i in range(len(d))]
    return {k: (shares(sums[k, "chars"]), shares(sums[k, "common"])) for k in sorted({k for k, _ in sums}) if sum(sums[k, "common"].values()) >= least_words}


def own_references(rare: DataFrame, least_words: int = 500) -> DataFrame:
    """lang, c, w: what ``references`` gives, as rows, for every language of ``rare`` (lang, n_words, chars, common)."""
    out = None
    for name, to in (("chars", "c"), ("common", "w")):
        sums = rare.select("lang", F.posexplode(name)).groupBy("lang", "pos").agg(F.sum("col").alias("n"))
        row = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("s"), F.sum("n").alias("total"))
        if name == "common":
            row = row.where(F.col("total") >= least_words)
        row = row.select("lang", F.expr("transform(s, x -> x.n / greatest(1D, total))").alias(to))
        out = row if out is None else out.join(row, "lang")
    return out


def js_distance(counts: str, share: list[float] | str) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) between an array of counts and shares (fixed, or a column's name); 1 for no counts."""
    q = share if isinstance(share, str) else f"array({', '.join(f'{float(v)!r}D' for v in share)})"
    total = f"aggregate({counts}, 0L, (a, x) -> a + x)"
    part = "if({x} > 0, {x} * log2(2 * {x} / (p + q)), 0D)"
    both = f"({part.format(x='p')} + {part.format(x='q')}) / 2"
    body = f"zip_with(transform({counts}, x -> x / t), {q}, (p, q) -> {both})"
    sums = f"aggregate(array({total}), 0D, (z, t) -> sqrt(greatest(0D, aggregate({body}, 0D, (a, x) -> a + x))))"
    return F.expr(f"if({total} = 0, 1D, {sums})")


def judge(docs: DataFrame, min_words: int = 60, min_chars: int = 200, max_char_distance: float = 0.3, max_word_distance: float = 0.45, languages: int = 32, per_language: int = 16) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, char_distance, word_distance, nearest.

    Null or empty text has no words, fails the base rules and is not kept. Texts with fewer than ``min_chars``
    characters in words skip the character distance, those with fewer than ``min_words`` words skip the word distance.
    ``nearest`` is the reference with the smallest sum of both distances (ties: by name), among those of the ``languages``
    commonest languages and the document's own. Where there is none, or the document's own language has none (it has too few words), only the base
    rules judge; nearest is then null. lang says which rows make up a reference and which can't be judged by one. Whole texts
    count, however long. doc_id may be null or repeat; other columns are ignored; no rows give none.
    """
    common = common_words(docs, per_language, languages)
    counted = materialize(histograms(docs, sorted({w for ws in common.values() for w in ws}), "lang"))
    found = references(counted, list(common))
    pairs = [_held(js_distance("chars", chars), js_distance("common", words), F.lit(k)) for k, (chars, words) in found.items()]
    listed = F.col("lang").isin(*common) if common else F.lit(False)
    usual, rare = counted.where(F.col("lang").isNull() | listed), counted.where(F.col("lang").isNotNull() & ~listed)
    out = _verdict(usual, pairs, F.col("lang").isNull() | F.col("lang").isin(*found), min_words, min_chars, max_char_distance, max_word_distance)
    if rare.isEmpty():
        return out
    own = rare.join(own_references(rare), "lang", "left")
    pairs.append(_held(js_distance("chars", "c"), js_distance("common", "w"), F.col("lang")))
    return out.unionByName(_verdict(own, pairs, F.col("c").isNotNull(), min_words, min_chars, max_char_distance, max_word_distance))


def _held(chars: Column, words: Column, name: Column) -> Column:
    return F.struct((chars + words).alias("d"), name.alias("k"), chars.alias("c"), words.alias("w"))


def _verdict(df: DataFrame, pairs: list[Column], judged: Column, min_words: int, min_chars: int, max_char_distance: float, max_word_distance: float) -> DataFrame:
    """``judge``'s columns of histograms held against ``pairs``, as made by ``_held``, where ``judged`` says so."""
    kind = "struct<d: double, k: string, c: double, w: double>"
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    df = df.withColumn("__best", F.when(judged, F.array_min(F.array(*pairs))) if pairs else F.lit(None).cast(kind))
    df = df.select("*", F.col("__best.c").alias("char_distance"), F.col("__best.w").alias("word_distance"), F.col("__best.k").alias("nearest"))
    far = ((F.col("word_chars") >= min_chars) & (F.col("char_distance") > max_char_distance)) | ((F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance))
    return df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance", "nearest"
    )
