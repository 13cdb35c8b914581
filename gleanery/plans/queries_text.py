"""Queries: projections, filters and text functions."""

from pyspark.sql import functions as F

from gleanery.functions import lexicon as L
from gleanery.functions import text as T
from gleanery.operators import preprocess, quality, subwords, timeseries
from gleanery.plans.base import query, sql
from gleanery.sources.reviews import labelled, reviews, table


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {lit(pattern)})"


ASCII = has("review_text", r"^[\x00-\x7F]+$")
LETTERS = "length(regexp_replace(review_text, '[^a-zA-Z]', '', 'g'))"
CLEAN = r"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', '', 'g'), '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"
FAILS = {"empty": "review_text IS NULL OR review_text = ''", "non_ascii": f"NOT {ASCII}", "too_short": "length(review_text) < 20", "few_letters": f"{LETTERS} < 0.5 * length(review_text)"}
STAGE = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in FAILS.items()) + " ELSE {other} END"
NEG = "[" + ", ".join(map(lit, L.NEGATION)) + "]"
BAD = "[" + ", ".join(map(lit, L.BAD_AFTER_NEGATION)) + "]"
#: SQL for a text whose letters and digits beyond ASCII are underscores: there RE2's word borders, which know ASCII only, are those of all letters.
PLAIN = lambda c: f"regexp_replace({c}, '[^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{Nd}}]', '_', 'g')"
LOW = PLAIN("lower(review_text)")
CAPS = r"length(regexp_replace(review_text, '[^\p{Lu}]', '', 'g')) >= 0.5 * length(regexp_replace(review_text, '[^\p{L}]', '', 'g')) AND length(regexp_replace(review_text, '[^\p{L}]', '', 'g')) >= 10"
DOUBLE = f"len(list_filter(range(1, len(t) + 1), lambda i: list_contains({NEG}, t[i]) AND list_has_any(t[i + 1:i + 5], {BAD}))) > 0"
WORDS = lambda ws: has(LOW, T.any_word(ws))
EITHER = lambda c, ps: has(c, "|".join(f"(?:{p})" for p in ps))
RULES = {
    "negation": WORDS(L.NEGATION), "double_negation": DOUBLE, "contrastive": WORDS(L.CONTRASTIVE), "strong_negative": WORDS(L.STRONG_NEGATIVE),
    "rating_symbol": EITHER(PLAIN("review_text"), L.RATING_SYMBOL), "slang": WORDS(L.SLANG), "emoticon": EITHER("review_text", [L.EMOJI, L.EMOTICON]),
    "conditional": EITHER(LOW, L.CONDITIONAL), "sarcasm_marker": EITHER(LOW, L.SARCASM_MARKER), "temporal_shift": EITHER(LOW, L.TEMPORAL_SHIFT),
    "bug_crash": WORDS(L.BUG_CRASH), "dev_criticism": WORDS(L.DEV_CRITICISM), "dlc_monetization": WORDS(L.DLC_MONETIZATION),
    "all_caps": CAPS, "short_text": "length(review_text) < 50", "long_text": "length(review_text) >= 300",
}
#: SQL list of the tags of a row that has review_text and its tokens t.
TAG_LIST = "list_filter([" + ", ".join(f"CASE WHEN {RULES[t]} THEN '{t}' END" for t in L.TAGS) + "], lambda x: x IS NOT NULL)"
TOKENS = "regexp_extract_all(lower(review_text), '[a-z'']+') AS t"


@query(sql(f"""SELECT game_name, coalesce(max(CASE WHEN label = 1 THEN p END), 0.0) AS positive, coalesce(max(CASE WHEN label = 0 THEN p END), 0.0) AS negative FROM (
    SELECT game_name, label, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY game_name), 6) AS p FROM labelled WHERE {STAGE.format(other="'valid'")} = 'valid' GROUP BY 1, 2) GROUP BY 1""", "reviews", "labelled"))
def slice_sentiment_pivot(spark, d):
    return timeseries.sentiment_pivot(timeseries.sentiment_shares(quality.valid_reviews(labelled(spark, d))))


@query("SELECT page_id, coalesce(url, '') AS review_text, false AS voted_up, CAST(page_id % 7 AS INTEGER) AS votes_up, '' AS language, CAST(0 AS BIGINT) AS timestamp_created, CAST(page_id AS VARCHAR) AS author FROM pages")
def p01_raw_projection(spark, d):
    from gleanery.sources.reviews import project_raw

    pages = table(spark, d, "pages")
    none = F.lit(None)
    payload = pages.select("page_id", F.col("url").alias("review"), none.cast("boolean").alias("voted_up"), (F.col("page_id") % 7).cast("int").alias("votes_up"), none.cast("string").alias("language"), none.cast("long").alias("timestamp_created"), F.struct(F.col("page_id").cast("string").alias("id")).alias("author"))
    return project_raw(payload).withColumn("page_id", F.col("author").cast("long"))


@query(sql(f"""SELECT review_id, c AS review_text, game_rating, review_helpfulness, language, posted_date, user_id FROM (SELECT review_id, {CLEAN.format(c='review_text')} AS c, label AS game_rating,
    CAST(votes_up AS INTEGER) AS review_helpfulness, language, timestamp_created AS posted_date, author AS user_id FROM labelled) WHERE c <> ''""", "reviews", "labelled"))
def p02_clean_reviews(spark, d):
    raw = labelled(spark, d).withColumn("voted_up", F.col("label") == 1)
    ids = raw.withColumn("author", F.concat_ws("|", "review_id", "author"))
    out = preprocess.clean_reviews(ids)
    return out.withColumn("review_id", F.split("user_id", "[|]")[0].cast("long")).withColumn("user_id", F.split("user_id", "[|]")[1])


@query(sql("SELECT review_id, review_text, label, g.game_title, 2020 AS game_year FROM labelled JOIN (SELECT DISTINCT game_id AS gid, 'Game ' || game_id AS game_title FROM reviews) g ON gid = game_id", "reviews", "labelled"))
def p03_literal_columns(spark, d):
    games = reviews(spark, d).select("game_id").distinct().withColumn("game_title", F.concat(F.lit("Game "), F.col("game_id").cast("string")))
    return preprocess.attach_games(labelled(spark, d).select("game_id", "review_id", "review_text", "label"), games).withColumn("game_year", F.lit(2020)).drop("game_id")


@query(sql("SELECT review_text, label AS sentiment, label = 1 AS recommended, language, timestamp_created, author, game_id, game_name FROM labelled", "reviews", "labelled"))
def p04_ood_columns(spark, d):
    df = labelled(spark, d).withColumn("voted_up", F.col("label") == 1)
    return df.withColumnRenamed("voted_up", "recommended").withColumnRenamed("label", "sentiment").drop("votes_up").select("review_text", "sentiment", "recommended", "language", "timestamp_created", "author", "game_id", "game_name")


@query(sql("SELECT review_id, label FROM labelled", "reviews", "labelled"))
def p05_truth_column(spark, d):
    from gleanery.sources.reviews import with_label

    return with_label(labelled(spark, d).select("review_id", F.col("label").alias("sentiment")))


@query(sql("SELECT review_id, CASE WHEN label = 1 THEN 'P' ELSE 'N' END AS actual, CASE WHEN pred_a = 1 THEN 'P' ELSE 'N' END AS predicted FROM labelled", "reviews", "labelled"))
def p06_polarity(spark, d):
    return labelled(spark, d).select("review_id", T.polarity(F.col("label")).alias("actual"), T.polarity(F.col("pred_a")).alias("predicted"))


@query(sql("SELECT row_number() OVER (ORDER BY timestamp_created, review_id) - 1 AS row_id, review_id FROM reviews QUALIFY length(review_text) >= 300", "reviews"))
def p08_stable_row_ids(spark, d):
    from gleanery.operators.sampling import row_ids

    rows = reviews(spark, d).select("review_id", "timestamp_created", (F.length("review_text") >= 300).alias("long"))
    return row_ids(rows, ["timestamp_created", "review_id"]).where("long").select("row_id", "review_id")


@query(sql("SELECT count(*) AS n FROM reviews WHERE review_text IS NOT NULL", "reviews"))
def f01_not_null(spark, d):
    return reviews(spark, d).dropna(subset=["review_text"]).agg(F.count("*").alias("n"))


@query(sql(f"SELECT review_id, coalesce({ASCII}, false) AS english FROM reviews", "reviews"))
def f02_is_english(spark, d):
    return reviews(spark, d).select("review_id", T.is_english(F.col("review_text")).alias("english"))


@query(sql(f"SELECT count(*) FILTER (WHERE {ASCII}) AS kept, count(*) FILTER (WHERE NOT coalesce({ASCII}, false)) AS dropped FROM reviews", "reviews"))
def f03_english_counts(spark, d):
    return quality.english_counts(reviews(spark, d))


@query(sql(f"SELECT review_id FROM reviews WHERE {STAGE.format(other="'valid'")} = 'valid'", "reviews"))
def f04_valid_reviews(spark, d):
    return quality.valid_reviews(reviews(spark, d)).select("review_id")


#: Naive Bayes over character trigrams in SQL: profiles of the reviews whose id isn't divisible by five, posterior of English for the rows of ``asked``.
GRAMS = "SELECT {keys}, lower(substr(review_text, i, 3)) AS gram FROM (SELECT {keys}, review_text, unnest(range(1, greatest(length(review_text) - 2, 1) + 1)) AS i FROM {rows})"
SCORED_EN = f"""counts AS (SELECT language, gram, count(*) AS c FROM ({GRAMS.format(keys='language', rows='(SELECT * FROM reviews WHERE review_id % 5 <> 0 AND review_text IS NOT NULL AND language IS NOT NULL)')}) GROUP BY 1, 2),
    totals AS (SELECT language, sum(c) AS total FROM counts GROUP BY 1), floors AS (SELECT language, ln(1.0 / (total + 300)) AS floor FROM totals),
    known AS (SELECT language, gram, ln((CAST(c AS DOUBLE) + 1) / (total + 300)) - floor AS gain FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY c DESC, gram) AS r FROM counts) JOIN totals USING (language) JOIN floors USING (language) WHERE r <= 300),
    asked_grams AS (SELECT review_id, gram, count(*) AS c FROM ({GRAMS.format(keys='review_id', rows='asked')}) GROUP BY 1, 2),
    sums AS (SELECT review_id, language, sum(c * gain) AS gain FROM asked_grams JOIN known USING (gram) GROUP BY 1, 2),
    posts AS (SELECT a.review_id, f.language, (length(a.review_text) - 2) * floor + coalesce(gain, 0) AS s FROM asked a CROSS JOIN floors f LEFT JOIN sums u ON u.review_id = a.review_id AND u.language = f.language),
    tops AS (SELECT *, max(s) OVER (PARTITION BY review_id) AS m FROM posts),
    english AS (SELECT review_id, sum(CASE WHEN language = 'en' THEN exp(s - m) ELSE 0 END) / sum(exp(s - m)) AS p FROM tops GROUP BY 1)"""
PASSED = f"SELECT * FROM reviews WHERE {STAGE.format(other="'valid'")} = 'valid'"


def english(asked: str, body: str) -> str:
    return sql("SELECT 1", "reviews").replace(" SELECT 1", f", asked AS ({asked}), {SCORED_EN} {body}")


def learned(spark, d):
    """Profiles of the reviews whose id isn't divisible by five; the others are judged unseen."""
    return quality.language_profiles(reviews(spark, d).where("review_id % 5 <> 0"))


@query(english(PASSED, "SELECT review_id, round(p, 6) AS p_en FROM english WHERE p >= 0.8"))
def f04_valid_english(spark, d):
    """All stages, the language score last and only for rows that pass the others."""
    return quality.valid_reviews(reviews(spark, d), language_score=quality.english_score(learned(spark, d))).select("review_id", F.round("p_en", 6).alias("p_en"))


@query(english(PASSED, f"""SELECT stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (
    SELECT CASE WHEN {STAGE.format(other="'valid'")} <> 'valid' THEN {STAGE.format(other="'valid'")} WHEN coalesce(p, 0) < 0.8 THEN 'not_english' ELSE 'valid' END AS stage FROM reviews LEFT JOIN english USING (review_id)) GROUP BY 1"""))
def f05_funnel_with_language(spark, d):
    return quality.funnel(reviews(spark, d), language_score=quality.english_score(learned(spark, d)))


@query(sql(f"SELECT stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT {STAGE.format(other="'valid'")} AS stage FROM reviews) GROUP BY stage", "reviews"))
def f05_rejection_funnel(spark, d):
    return quality.funnel(reviews(spark, d))


@query(sql(f"SELECT review_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {lit(n)} END' for n, c in FAILS.items() if n != 'empty')}], lambda x: x IS NOT NULL), ',') AS reasons FROM reviews WHERE review_text <> ''", "reviews"))
def f06_rejection_reasons(spark, d):
    return reviews(spark, d).where("review_text <> ''").select("review_id", F.array_join(quality.all_reasons(F.col("review_text")), ",").alias("reasons"))


@query(sql("SELECT count(*) FILTER (WHERE label = 0 AND pred_a = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pred_a = 0) AS fn FROM labelled", "reviews", "labelled"))
def f07_error_masks(spark, d):
    from gleanery.operators.errors import error_type

    e = error_type()
    return labelled(spark, d).agg(F.count_if(e == "FP").alias("fp"), F.count_if(e == "FN").alias("fn"))


@query(sql("SELECT review_id, confidence FROM labelled WHERE confidence >= 0.9 ORDER BY confidence DESC, review_id LIMIT 20", "reviews", "labelled"))
def f08_threshold_head(spark, d):
    return labelled(spark, d).where("confidence >= 0.9").orderBy(F.desc("confidence"), "review_id").select("review_id", "confidence").limit(20)


@query(sql("SELECT count(*) AS n FROM (SELECT CASE WHEN review_id % 7 = 0 THEN 'failed' WHEN review_id % 2 = 0 THEN '' END AS error FROM reviews) WHERE coalesce(error, '') = ''", "reviews"))
def f09_successful_runs(spark, d):
    rows = reviews(spark, d).select(F.when(F.col("review_id") % 7 == 0, "failed").when(F.col("review_id") % 2 == 0, "").alias("error"))
    return rows.where(F.coalesce("error", F.lit("")) == "").agg(F.count("*").alias("n"))


#: The first seven games stand for the seven that models were trained on.
APP = f"CASE {' '.join(f'WHEN game_id = {i} THEN {a}' for i, a in enumerate(L.TRAINING_GAMES))} ELSE game_id END"


@query(sql(f"SELECT review_id, {APP} AS app_id FROM reviews WHERE {APP} NOT IN ({', '.join(map(str, L.TRAINING_GAMES))})", "reviews"))
def f10_excluded_games(spark, d):
    rows = reviews(spark, d).select("review_id", F.expr(APP).cast("long").alias("app_id"))
    return rows.where(~F.col("app_id").isin(L.TRAINING_GAMES))


STOP = ", ".join(map(lit, L.STOPWORDS + L.CONTRACTION_FRAGMENTS))


@query(sql(f"SELECT token, count(*) AS n FROM tok WHERE length(token) >= 3 AND token NOT IN ({STOP}) AND regexp_matches(token, '[a-z]') GROUP BY token", "reviews", "tok", errors="reviews"))
def f11_meaningful_tokens(spark, d):
    rows = T.unnest(reviews(spark, d), T.tokens(F.col("review_text")), "token")
    return rows.where(T.meaningful(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


@query(sql("SELECT game_id, count(*) FILTER (WHERE label = 1) AS n_positive, count(*) FILTER (WHERE label = 0) AS n_negative FROM labelled GROUP BY 1 HAVING n_positive >= 3 AND n_negative >= 3", "reviews", "labelled"))
def f12_complete_games(spark, d):
    from gleanery.operators.sampling import complete_groups

    return complete_groups(labelled(spark, d), "game_id", "label", 3)


@query(f"SELECT page_id, {CLEAN.format(c='html')} AS cleaned FROM pages")
def n01_clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_text(F.col("html")).alias("cleaned"))


#: As PLAIN, but undone afterwards: letters beyond ASCII stand between underscores that a control character marks.
FENCED = r"regexp_replace(review_text, '([^\x00-\x7F\P{L}]|[^\x00-\x7F\P{Nd}])', '_' || chr(1) || '\1' || chr(1) || '_', 'g')"


@query(sql(f"""SELECT review_id, trim(regexp_replace(regexp_replace({FENCED}, '(?i)\\b(?:' || w || ')\\b', '', 'g'), '_\\x01|\\x01_', '', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS review_text
    FROM (SELECT review_id, review_text, CASE WHEN game_id % 2 = 0 THEN 'there|with' ELSE 'then' END AS w FROM reviews)""", "reviews"))
def n02_remove_game_names(spark, d):
    title = F.when(F.col("game_id") % 2 == 0, "There 2077 and WITH it").otherwise("Of Then")
    return preprocess.remove_game_names(reviews(spark, d).withColumn("game_name", title)).select("review_id", "review_text")


@query(sql("SELECT review_id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(review_text), '[a-z0-9]+'), lambda w: length(w) > 3 AND NOT regexp_matches(w, '^[0-9]+$')))) AS BIGINT) AS n_words FROM reviews", "reviews"))
def n03_title_words(spark, d):
    return reviews(spark, d).select("review_id", F.size(T.title_words(F.col("review_text"))).cast("long").alias("n_words"))


@query(sql(f"SELECT review_id, {WORDS(['the', 'is', 'with', 'not'])} AS found FROM reviews", "reviews"))
def n04_contains_word(spark, d):
    return reviews(spark, d).select("review_id", T.contains_any(F.lower("review_text"), ["the", "is", "with", "not"]).alias("found"))


@query(sql(f"SELECT review_id, {DOUBLE} AS found FROM (SELECT *, {TOKENS} FROM reviews)", "reviews"))
def n05_double_negation(spark, d):
    return reviews(spark, d).select("review_id", T.double_negation(F.col("review_text")).alias("found"))


@query(sql(f"SELECT review_id, {CAPS} AS caps FROM reviews", "reviews"))
def n06_all_caps(spark, d):
    return reviews(spark, d).select("review_id", F.coalesce(T.all_caps(F.col("review_text")), F.lit(False)).alias("caps"))


@query(sql(f"SELECT review_id, array_to_string({TAG_LIST}, ',') AS tags FROM (SELECT *, {TOKENS} FROM reviews)", "reviews"))
def n07_assign_tags(spark, d):
    return reviews(spark, d).select("review_id", F.array_join(T.tags(F.col("review_text")), ",").alias("tags"))


@query(english("SELECT * FROM reviews WHERE length(review_text) >= 3", "SELECT review_id, round(p, 6) AS p_en FROM english"))
def n08_language_score(spark, d):
    return quality.score_column(reviews(spark, d).where("length(review_text) >= 3"), learned(spark, d)).select("review_id", F.round("p_en", 6).alias("p_en"))


@query(sql(f"SELECT review_id, round({LETTERS} / length(review_text), 6) AS share FROM reviews WHERE length(review_text) > 0", "reviews"))
def n09_letter_share(spark, d):
    return reviews(spark, d).where("length(review_text) > 0").select("review_id", F.round(T.letter_share(F.col("review_text")), 6).alias("share"))


@query(sql("SELECT review_id, substr(replace(review_text, chr(10), ' '), 1, 80) AS preview FROM reviews", "reviews"))
def n10_preview(spark, d):
    return reviews(spark, d).select("review_id", T.preview(F.col("review_text")).alias("preview"))


#: SQL for (review_id, term): words of four letters or more without stop words, and pairs of neighbours.
TERMS = f"""SELECT review_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (
    SELECT review_id, list_filter(regexp_extract_all(lower(review_text), '[a-zA-Z]{{4,}}'), lambda x: x NOT IN ({', '.join(map(lit, L.STOPWORDS))})) AS w FROM reviews)"""


@query(sql(f"SELECT term, count(*) AS tf, count(DISTINCT review_id) AS df FROM ({TERMS}) GROUP BY term HAVING count(DISTINCT review_id) >= 2", "reviews"))
def n11_count_vectorizer(spark, d):
    rows = reviews(spark, d).select(F.explode(T.counted(T.terms(F.col("review_text")))).alias("t"))
    return rows.groupBy(F.col("t.item").alias("term")).agg(F.sum("t.n").alias("tf"), F.count("*").alias("df")).where("df >= 2")


@query(sql("SELECT review_id, least(len(t), 128) AS n_tokens, greatest(128 - len(t), 0) AS n_padding FROM (SELECT review_id, regexp_extract_all(lower(review_text), '[a-z'']+') AS t FROM reviews)", "reviews"))
def n12_fixed_length(spark, d):
    x = reviews(spark, d).select("review_id", T.fixed_length(T.tokens(F.col("review_text"))).alias("x"))
    ones = F.aggregate("x.mask", F.lit(0), lambda a, m: a + m).cast("long")
    return x.select("review_id", ones.alias("n_tokens"), (F.size("x.items").cast("long") - ones).alias("n_padding"))


def vocabulary() -> list[str]:
    import public_tokenizers

    return subwords.vocabulary_from(public_tokenizers.path("byte_bpe_50k.json"))


@query()
def n12_subword_ids(spark, d):
    """Sub-word ids of every text at length 128, with mask, and the pieces of the whole text."""
    return subwords.encode(reviews(spark, d), vocabulary())


@query()
def f11_meaningful_pieces(spark, d):
    """Meaningful pieces among the sub-word ids: continuations and marks fall out."""
    pieces = vocabulary()
    rows = subwords.pieces_of(subwords.encode(reviews(spark, d), pieces), pieces)
    return rows.where(T.meaningful(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


@query(sql(f"SELECT review_id, list_contains(string_split(array_to_string({TAG_LIST}, ','), ','), 'long_text') AS found FROM (SELECT *, {TOKENS} FROM reviews)", "reviews"))
def n13_tag_membership(spark, d):
    return reviews(spark, d).select("review_id", T.has_tag(F.array_join(T.tags(F.col("review_text")), ","), "long_text").alias("found"))


@query(sql("SELECT review_id, round_even(CAST(n_chars AS DOUBLE) / 8, 2) AS r FROM reviews", "reviews"))
def n15_round_half_even(spark, d):
    return reviews(spark, d).select("review_id", F.bround(F.col("n_chars") / F.lit(8.0), 2).alias("r"))
