"""Text rules on literal cases."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import lexicon as L
from gleanery.functions import text as T
from gleanery.operators import errors, preprocess, quality


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CLEAN = {
    "<b>Great game!</b>": "Great game!", "Too many   spaces": "Too many spaces", "  Trim whitespace  ": "Trim whitespace",
    "Line\nbreaks\nhere": "Line breaks here", "<div>HTML <span>tags</span></div>": "HTML tags", None: "", "a 　b\x1cc": "a b c",
}


def test_clean_text(spark):
    assert column(spark, list(CLEAN), T.clean_text) == list(CLEAN.values())


def test_is_english(spark):
    cases = {"This is a great game!": True, "I love this game": True, "10/10": True, "これは素晴らしい": False, "Отличная игра": False, "很好玩": False, "good 楽しい": False, "": False, None: False}
    assert column(spark, list(cases), T.is_english) == list(cases.values())


def test_english_filter(spark):
    df = spark.createDataFrame([(t,) for t in ("Great game", "素晴らしい", "Good", "Отлично", "Fun")], "review_text string")
    assert quality.english_reviews(df).count() == 3
    assert tuple(quality.english_counts(df).first()) == (3, 2)


TAGS = {
    "I do not like it": ["negation", "short_text"],
    "not really all that terrible but fun": ["negation", "double_negation", "contrastive", "short_text"],
    "100% fun": ["short_text"],
    "100%fun": ["rating_symbol", "short_text"],
    "★": ["rating_symbol", "emoticon", "short_text"],
    "xD": ["emoticon", "short_text"],
    "taxDoc": ["short_text"],
    "THIS GAME IS BROKEN": ["bug_crash", "all_caps", "short_text"],
    "I would have been happy, if only": ["conditional", "short_text"],
    'so "great" a game /s': ["sarcasm_marker", "short_text"],
    "used to be free, greedy cash grab with dlc": ["temporal_shift", "dev_criticism", "dlc_monetization", "short_text"],
    "no cap this is trash, gg": ["negation", "strong_negative", "slang", "short_text"],
    "x" * 300: ["long_text"],
    "": [],
    None: [],
}


def test_tags(spark):
    assert column(spark, list(TAGS), T.tags) == list(TAGS.values())
    assert sorted(L.TAGS) == sorted(L.REPORT_ORDER)


def test_double_negation_reaches_five_tokens(spark):
    cases = {"not a b c d bad": True, "not a b c d e bad": False, "bad not": False, "": False}
    assert column(spark, list(cases), T.double_negation) == list(cases.values())


def test_meaningful_tokens(spark):
    cases = {"game": True, "[CLS]": False, "##ing": False, "123": False, "ab": False, "The": False, "don": False, None: False, "été": True}
    assert column(spark, list(cases), T.meaningful) == list(cases.values())


def test_remove_game_names(spark):
    rows = [(1, " I love Stardew VALLEY, the valleys ", "Stardew Valley 2016"), (2, " It is ok ", "It 2"), (3, " x ", None)]
    got = {r.i: r.review_text for r in preprocess.remove_game_names(spark.createDataFrame(rows, "i int, review_text string, game_name string")).collect()}
    assert got == {1: "I love  , the valleys", 2: " It is ok ", 3: " x "}


def test_terms(spark):
    assert column(spark, ["Great great the gameplay", "one two", None], T.terms) == [["great", "great", "gameplay", "great great", "great gameplay"], [], None]


def test_fixed_length(spark):
    got = column(spark, [["a", "b"], ["a"] * 130], T.fixed_length, "array<string>")
    assert [(len(r.items), sum(r.mask), r.items[-1]) for r in got] == [(128, 2, "[PAD]"), (128, 128, "a")]


def test_reasons(spark):
    cases = ["", None, "short", "1234567890 1234567890 x", "素晴らしい", "a perfectly valid review text"]
    assert column(spark, cases, quality.first_reason) == ["empty", "empty", "too_short", "few_letters", "non_ascii", None]
    assert column(spark, ["素晴らしい"], quality.all_reasons) == [["non_ascii", "too_short", "few_letters"]]


def test_language_score_is_asked_last(spark):
    df = spark.createDataFrame([("a perfectly valid review text", 0.9), ("a perfectly valid review text", 0.1), ("a perfectly valid review text", None), ("short", 1.0)], "review_text string, p double")
    assert quality.valid_reviews(df, language_score=F.col("p")).count() == 1


def test_language_scorer_tells_languages(spark, sf_dir):
    from gleanery.plans.registry import QUERIES
    from gleanery.sources.reviews import reviews

    got = QUERIES["n08_language_score"](spark, sf_dir).join(reviews(spark, sf_dir).select("review_id", "language"), "review_id").where("review_id % 5 = 0").collect()
    assert sum((r.p_en >= 0.5) == (r.language == "en") for r in got) / len(got) > 0.9


def test_clean_reviews(spark):
    rows = [("<b>ok</b>", True, 3, "english", 5, "u"), ("<i></i> ", False, 0, "english", 6, "v"), (None, None, None, None, None, None)]
    got = preprocess.clean_reviews(spark.createDataFrame(rows, "review_text string, voted_up boolean, votes_up int, language string, timestamp_created bigint, author string"))
    assert [tuple(r) for r in got.collect()] == [("ok", 1, 3, "english", 5, "u")]
    with pytest.raises(ValueError):
        preprocess.clean_reviews(got)


def test_difference_is_null_safe_and_keeps_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "review_id int, review_text string")
    b = spark.createDataFrame([("y",), (None,), (None,)], "review_text string")
    assert sorted(r.review_id for r in errors.difference(a, b).collect()) == [1, 2]


def test_unescape(spark):
    assert column(spark, ["&lt;a&gt; &amp;lt; &quot;&#39;"], T.unescape_entities) == ["<a> &lt; \"'"]


def test_terms_and_double_negation_are_linear(spark):
    """Forty thousand words take no more than a few times what ten thousand take."""
    import time

    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"word{chr(97 + i % 26)} isn't" for i in range(n // 2)),)], "t string")
        start = time.perf_counter()
        df.select(T.terms(F.col("t")).alias("a"), T.double_negation(F.col("t")).alias("b")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(100)
    assert seconds(40_000) < 6 * max(seconds(10_000), 0.5)


def test_counted_items(spark):
    data = [["b", "a", "b", "c", "b"], [], None, ["x"], ["k"] * 5000]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "id int, items array<string>")
    got = {r.id: r.c and [tuple(x) for x in r.c] for r in df.select("id", T.counted(F.col("items")).alias("c")).collect()}
    assert got == {0: [("a", 1), ("b", 3), ("c", 1)], 1: None, 2: None, 3: [("x", 1)], 4: [("k", 5000)]}
