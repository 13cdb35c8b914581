"""Column functions on texts. All are built-in expressions: they stay in whole-stage code and need no Python worker."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import lexicon as L

ASCII = r"^[\x00-\x7F]+$"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often lambdas inside refer to it."""
    return F.transform(F.array(value), use)[0]


def unnest(df: DataFrame, items: Column, name: str, *keep: str) -> DataFrame:
    """One row an item; ``items`` without nulls. The outer form spares the filter on the array's size that a plain explode
    sends below joins, where the array would be computed a second time and for rows that no join keeps."""
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def digest(text: Column) -> Column:
    """SHA-256 of a text, a key of fixed size for it; null for null."""
    return F.sha2(text.cast("binary"), 256)


def clean_text(text: Column) -> Column:
    """Without tags, white space runs as one space, trimmed; null becomes empty."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", "")
    return F.trim(F.regexp_replace(bare, r"(?U)[\s\x1c-\x1f]+", " "))


def is_english(text: Column) -> Column:
    """ASCII characters only, and at least one; false for null."""
    return F.coalesce(text.rlike(ASCII), F.lit(False))


def letter_share(text: Column) -> Column:
    """Share of a-z and A-Z among all characters; null for null and empty texts."""
    return F.length(F.regexp_replace(text, "[^a-zA-Z]", "")) / F.nullif(F.length(text), F.lit(0))


def title_words(title: Column) -> Column:
    """Distinct words of a title that are worth removing: over three characters, not numeric, lower case."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), 1), lambda w: (F.length(w) > 3) & ~w.rlike("^[0-9]+$")))


def remove_words(text: Column, words: Column) -> Column:
    """``text`` without the whole words of an array, whatever their case, then stripped; unchanged where the array is null or empty."""
    pattern = F.concat(F.lit(r"(?i)\b(?:"), F.array_join(words, "|"), F.lit(r")\b"))
    bare = F.regexp_replace(F.regexp_replace(text, pattern, F.lit("")), F.lit(r"^\s+|\s+$"), F.lit(""))
    return F.when(F.size(F.coalesce(words, F.array().cast("array<string>"))) > 0, bare).otherwise(text)


def any_word(words: list[str]) -> str:
    """One pattern for a list of words and phrases, each between word borders."""
    return r"\b(?:" + "|".join(map(re.escape, words)) + r")\b"


def contains_any(text: Column, words: list[str]) -> Column:
    return text.rlike(any_word(words))


def tokens(text: Column) -> Column:
    """Runs of a-z and apostrophes in the lower-case text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), 1)


def holds(text: Column, parts: list[str]) -> Column:
    """Whether a text has one of ``parts`` anywhere: a cheap condition that a pattern needs, asked before it."""
    return reduce(or_, [text.contains(p) for p in parts])


def double_negation(text: Column) -> Column:
    """A negative word within five tokens after a negation."""
    bad = F.array(*map(F.lit, L.BAD_AFTER_NEGATION))
    near = lambda found: F.transform(found, lambda x, i: x.isin(L.NEGATION) & F.arrays_overlap(F.slice(found, i + 2, F.lit(5)), bad))
    return holds(F.lower(text), L.BAD_AFTER_NEGATION) & let(tokens(text), lambda found: F.exists(near(found), lambda x: x))


def all_caps(text: Column, share: float = 0.5) -> Column:
    """Ten letters or more, of which at least ``share`` are upper case."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    upper = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))
    return let(F.struct(letters.alias("n"), upper.alias("u")), lambda v: (v["n"] >= 10) & (v["u"] >= share * v["n"]))


WORD_LISTS = (L.NEGATION, L.CONTRASTIVE, L.STRONG_NEGATIVE, L.SLANG, L.BUG_CRASH, L.DEV_CRITICISM, L.DLC_MONETIZATION)
PLAIN_WORDS = [w for w in dict.fromkeys(w for words in WORD_LISTS for w in words) if w.isalnum()]


def word_hits(low: Column) -> Column:
    """Distinct words of a lower-case text that one of WORD_LISTS has: one pass for all lists. A word is what lies between two word borders."""
    found = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{Nd}_][\p{L}\p{Nd}_\p{Mn}]*)"), 1)
    return F.array_distinct(F.filter(found, lambda w: w.isin(PLAIN_WORDS)))


def tag_rules(text: Column, low: Column | None = None, hits: Column | None = None) -> dict[str, Column]:
    """A condition for each tag; ``low`` and ``hits`` are the lower-case text and its ``word_hits``, if there are any already. Patterns are only tried on texts that hold a part they need."""
    low = F.lower(text) if low is None else low
    hits = word_hits(low) if hits is None else hits
    either = lambda t, patterns: t.rlike("|".join(f"(?:{p})" for p in patterns))

    def listed(words: list[str]) -> Column:
        plain, phrases = [w for w in words if w.isalnum()], [w for w in words if not w.isalnum()]
        found = F.arrays_overlap(hits, F.array(*map(F.lit, plain)))
        return found | (holds(low, phrases) & contains_any(low, phrases)) if phrases else found

    return {
        "negation": listed(L.NEGATION),
        "double_negation": double_negation(text),
        "contrastive": listed(L.CONTRASTIVE),
        "strong_negative": listed(L.STRONG_NEGATIVE),
        "rating_symbol": holds(text, ["★", "/10", "100%"]) & either(text, L.RATING_SYMBOL),
        "slang": listed(L.SLANG),
        "emoticon": ((F.length(text) != F.octet_length(text)) & text.rlike(L.EMOJI)) | (text.rlike("[:;=8<>^_]|[xX]D") & text.rlike(L.EMOTICON)),
        "conditional": holds(low, ["would", "could", "should", "might", "if only"]) & either(low, L.CONDITIONAL),
        "sarcasm_marker": holds(low, ['"', "/s", "oh", "yeah", "what a "]) & either(low, L.SARCASM_MARKER),
        "temporal_shift": holds(low, ["used to", "until ", "no longer", "ever since", "nowadays", "these days", "back "]) & either(low, L.TEMPORAL_SHIFT),
        "bug_crash": listed(L.BUG_CRASH),
        "dev_criticism": listed(L.DEV_CRITICISM),
        "dlc_monetization": listed(L.DLC_MONETIZATION),
        "all_caps": all_caps(text),
        "short_text": F.length(text) < 50,
        "long_text": F.length(text) >= 300,
    }


def tags(text: Column) -> Column:
    """All tags that fit a text, in the order of TAGS; none for null and empty texts."""

    def found(v: Column) -> Column:
        rules = tag_rules(text, v["low"], v["hits"])
        return F.array_compact(F.array(*[F.when(rules[t], F.lit(t)) for t in L.TAGS]))

    low = F.lower(text)
    each = let(F.struct(low.alias("low"), word_hits(low).alias("hits")), found)
    return F.when(F.length(F.coalesce(text, F.lit(""))) > 0, each).otherwise(F.array().cast("array<string>"))


def preview(text: Column, size: int = 80) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, size)


def has_tag(listed: Column, tag: str) -> Column:
    """Whether a comma list holds ``tag`` as a whole entry."""
    return F.array_contains(F.split(F.coalesce(listed, F.lit("")), ","), tag)


def terms(text: Column, stop: list[str] = L.STOPWORDS) -> Column:
    """Unigrams and bigrams of words of four letters or more, stop words out before pairs are made."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z]{4,})"), 1), lambda w: ~w.isin(stop))
    pairs = lambda ws: F.transform(F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda w, i: F.concat(F.get(ws, i), F.lit(" "), w))
    return let(words, lambda ws: F.concat(ws, pairs(ws)))


def counted(items: Column) -> Column:
    """Distinct items with how often each occurs, (item, n) in order: sorted once, so repeats never leave their row."""
    edges = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda v: F.transform(v["at"], lambda p, i: F.struct(F.get(v["s"], p).alias("item"), (F.coalesce(F.get(v["at"], i + 1), F.size(v["s"])) - p).cast("long").alias("n")))
    some = let(F.sort_array(items), lambda s: let(F.struct(s.alias("s"), edges(s).alias("at")), runs))
    return F.when(F.size(items) > 0, some)


def fixed_length(items: Column, size: int = 128, pad: str = "[PAD]") -> Column:
    """(items cut or padded to ``size``, mask of 1 for items and 0 for padding)."""
    cut = F.slice(items, 1, size)
    gap = F.lit(size) - F.size(cut)
    return F.struct(F.concat(cut, F.array_repeat(F.lit(pad), gap)).alias("items"), F.concat(F.transform(cut, lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap)).alias("mask"))


def meaningful(token: Column, shortest: int = 3) -> Column:
    """Tokens that say something: no special token or word piece, a letter, long enough, neither a stop word nor a piece of a contraction."""
    low = F.lower(token)
    good = ~token.startswith("[") & ~token.startswith("##") & token.rlike(r"\p{L}") & (F.length(token) >= shortest) & ~low.isin(L.STOPWORDS + L.CONTRACTION_FRAGMENTS)
    return F.coalesce(good, F.lit(False))


def polarity(label: Column) -> Column:
    return F.when(label == 1, "P").otherwise("N")


def unescape_entities(text: Column) -> Column:
    """The five XML entities; ``&amp;`` last, so nothing is undone twice."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def page_tags(html: Column, css_class: str | None = "app_tag", most: int = 6) -> Column:
    """Texts of the first ``most`` anchors of a class (None: of any), entities undone, empty ones left out."""
    opening = "<a[^>]*>" if css_class is None else f'class="{re.escape(css_class)}"[^>]*>'
    found = F.transform(F.regexp_extract_all(html, F.lit(opening + "([^<]*)</a>"), 1), lambda x: F.regexp_replace(unescape_entities(x), r"^\s+|\s+$", ""))
    return F.slice(F.filter(found, lambda x: x != ""), 1, most)
