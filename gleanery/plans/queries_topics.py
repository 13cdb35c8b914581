"""Queries: topics, models and attributions."""

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import adaptation, errors, experiments, models, neural, sampling
from gleanery.operators import topics as P
from gleanery.plans.base import query, sql
from gleanery.plans.queries_text import TERMS
from gleanery.sources.reviews import labelled, reviews, table
from gleanery.sources.reviews import topical as with_topics
from gleanery.sources.scratch import materialize

TOPICAL = ("reviews", "topical")


def topical(spark, d):
    return with_topics(reviews(spark, d), spark, d)


def names(spark, d):
    return P.topic_names(P.topic_words(scores(spark, d)))


def scores(spark, d):
    # written once: the scores read the counts four times, and texts should not be split as often
    return P.class_tfidf(materialize(P.term_counts(topical(spark, d), T.terms(F.col("review_text")))))


#: c-TF-IDF over (topic_id, term) in SQL.
CTFIDF = f"""terms AS ({TERMS}), per_doc AS (SELECT review_id, term, count(*) AS c FROM terms GROUP BY 1, 2), common AS (SELECT term FROM per_doc GROUP BY 1 HAVING count(*) >= 2),
    counts AS (SELECT topic_id, term, CAST(sum(c) AS BIGINT) AS tf FROM per_doc JOIN common USING (term) JOIN (SELECT review_id, topic_id FROM topical) USING (review_id) GROUP BY 1, 2),
    sizes AS (SELECT topic_id, sum(tf) AS words FROM counts GROUP BY 1), overall AS (SELECT term, sum(tf) AS f FROM counts GROUP BY 1),
    score AS (SELECT topic_id, term, tf, round(CAST(tf AS DOUBLE) / words * ln(1 + (SELECT avg(words) FROM sizes) / f), 6) AS score FROM counts JOIN sizes USING (topic_id) JOIN overall USING (term)),
    best AS (SELECT * FROM (SELECT topic_id, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, term) AS INTEGER) AS rank, term, score FROM score) WHERE rank <= 10),
    named AS (SELECT topic_id, topic_id || '_' || array_to_string(list(term ORDER BY rank)[1:4], '_') AS topic_name, array_to_string(list(term ORDER BY rank), ', ') AS keywords FROM best GROUP BY 1)"""


def over_terms(body: str) -> str:
    return sql("SELECT 1", *TOPICAL).replace(" SELECT 1", f", {CTFIDF} {body}")


@query(over_terms("SELECT * FROM score"))
def m08_class_tfidf(spark, d):
    return scores(spark, d)


@query(over_terms("SELECT * FROM best"))
def m10_topic_words(spark, d):
    return P.topic_words(scores(spark, d))


@query(over_terms("SELECT topic_id, count(*) AS n, coalesce(any_value(topic_name), CAST(topic_id AS VARCHAR)) AS topic_name FROM topical LEFT JOIN named USING (topic_id) GROUP BY topic_id"))
def m09_topic_info(spark, d):
    return P.topic_info(topical(spark, d), names(spark, d))


@query(over_terms("""SELECT topic_id, CASE WHEN topic_id = -1 THEN 'Outlier' ELSE any_value(topic_name) END AS topic_name, CASE WHEN topic_id = -1 THEN 'N/A' ELSE any_value(keywords) END AS keywords, count(*) AS n,
    round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM topical LEFT JOIN named USING (topic_id) GROUP BY topic_id"""))
def a18_topic_statistics(spark, d):
    return P.topic_statistics(topical(spark, d), names(spark, d))


@query(over_terms("SELECT review_id, topic_id, topic_name FROM topical LEFT JOIN named USING (topic_id)"))
def p09_topic_lookup(spark, d):
    return P.attach_lookup(topical(spark, d), names(spark, d)).select("review_id", "topic_id", "topic_name")


@query(sql("SELECT topic_id, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, topic_id) AS INTEGER) AS rank, count(*) OVER () AS n_topics FROM topical WHERE topic_id <> -1 GROUP BY topic_id", *TOPICAL))
def a19_topic_ranking(spark, d):
    return P.topic_ranking(topical(spark, d))


@query(sql("SELECT topic_id, rank, review_id, substr(replace(review_text, chr(10), ' '), 1, 80) AS preview FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY review_id) AS INTEGER) AS rank FROM topical) WHERE rank <= 3", *TOPICAL))
def w04_topic_samples(spark, d):
    return P.topic_samples(topical(spark, d))


@query()
def m08_assign_topics(spark, d):
    return P.assign(table(spark, d, "embeddings"), 10).groupBy("topic_id").agg(F.count("*").alias("n"))


@query()
def m08_density_topics(spark, d):
    """Dense topics of ``embeddings`` with outliers and probabilities; ten vectors make a topic."""
    return P.density_topics(table(spark, d, "embeddings"), 10)


@query()
def m08_density_topics_20(spark, d):
    return P.density_topics(table(spark, d, "embeddings"), 20)


def text_topics(spark, d):
    """(review_id, topic_id, probability) of whole texts, written once: what follows reads it again."""
    return materialize(P.text_topics(reviews(spark, d)))


@query()
def m08_text_topics(spark, d):
    """Texts to vectors to topics."""
    return text_topics(spark, d)


@query()
def m08_text_topic_words(spark, d):
    """Best terms of each topic found in the texts."""
    docs = reviews(spark, d).join(text_topics(spark, d), "review_id")
    return P.topic_words(P.class_tfidf(materialize(P.term_counts(docs, T.terms(F.col("review_text"))))))


@query()
def m08_text_demand(spark, d):
    """Demand, fulfilment and share of all reviews of each topic found in the texts, outliers included."""
    return P.text_demand(labelled(spark, d), text_topics(spark, d))


def split(spark, d):
    df = labelled(spark, d)
    return df.where("review_id % 5 <> 0"), df


@query()
def m01_sentiment_scores(spark, d):
    """Scores of every labelled review by a model fitted on four fifths of them."""
    train, every = split(spark, d)
    return models.score(every, models.fit(train))


#: A masked-token model of the reviews of even games, before and after the counts of odd games' reviews are added; asked about masked tokens of odd games' held-out reviews.
MASKED = """places AS (SELECT review_id, game_id, pos - 1 AS pos, coalesce(CASE WHEN pos > 1 THEN t[pos - 1] END, '') AS l, t[pos] AS w, coalesce(t[pos + 1], '') AS r
        FROM (SELECT review_id, game_id, t, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT review_id, game_id, regexp_extract_all(lower(review_text), '[a-z'']+') AS t FROM reviews))),
    held AS (SELECT l, w, r FROM places WHERE game_id % 2 = 1 AND review_id % 5 = 0 AND (review_id * 7919 + pos * 104729 + review_id * pos * 31 + 42) % 100 < 15),
    learned AS (SELECT 'before' AS model, l, w, r FROM places WHERE game_id % 2 = 0 UNION ALL SELECT 'after', l, w, r FROM places WHERE game_id % 2 = 0 OR review_id % 5 <> 0),
    total AS (SELECT model, count(*) AS n, count(DISTINCT w) AS v FROM learned GROUP BY 1),
    ltr AS (SELECT model, l, w, r, count(*) AS c FROM learned GROUP BY ALL), lr AS (SELECT model, l, r, count(*) AS c FROM learned GROUP BY ALL), lt AS (SELECT model, l, w, count(*) AS c FROM learned GROUP BY ALL),
    tr AS (SELECT model, w, r, count(*) AS c FROM learned GROUP BY ALL), sl AS (SELECT model, l, count(*) AS c FROM learned GROUP BY ALL), sr AS (SELECT model, r, count(*) AS c FROM learned GROUP BY ALL), st AS (SELECT model, w, count(*) AS c FROM learned GROUP BY ALL),
    p AS (SELECT o.model, (coalesce(ltr.c, 0) + 2 * (coalesce(lt.c, 0) + coalesce(tr.c, 0) + 2 * (coalesce(st.c, 0) + 1) / (n + v + 1)) / (coalesce(sl.c, 0) + coalesce(sr.c, 0) + 2)) / (coalesce(lr.c, 0) + 2) AS p
        FROM held h CROSS JOIN total o LEFT JOIN ltr ON ltr.model = o.model AND ltr.l = h.l AND ltr.w = h.w AND ltr.r = h.r LEFT JOIN lr ON lr.model = o.model AND lr.l = h.l AND lr.r = h.r
        LEFT JOIN lt ON lt.model = o.model AND lt.l = h.l AND lt.w = h.w LEFT JOIN tr ON tr.model = o.model AND tr.w = h.w AND tr.r = h.r LEFT JOIN sl ON sl.model = o.model AND sl.l = h.l
        LEFT JOIN sr ON sr.model = o.model AND sr.r = h.r LEFT JOIN st ON st.model = o.model AND st.w = h.w)
    SELECT model, count(*) AS n, round(exp(-avg(ln(p))), 4) AS perplexity FROM p GROUP BY 1"""


@query(sql("SELECT 1", "reviews").replace(" SELECT 1", f", {MASKED}"))
def m07_masked_perplexity(spark, d):
    """Perplexity of masked tokens before and after adaptation to the domain."""
    places = adaptation.contexts(reviews(spark, d), carry=("game_id",))
    odd, held_out = F.col("game_id") % 2 == 1, F.col("review_id") % 5 == 0
    held = places.where(odd & held_out & adaptation.masked(F.col("review_id"), F.col("pos")))
    found = adaptation.compared(held, places.where(~odd | ~held_out), ~odd)
    return found.select("model", "n", F.round("perplexity", 4).alias("perplexity"))


def trained(spark, d):
    """(network, history) of the labelled reviews' own training, validation and test splits."""
    return neural.train(neural.prepare(sampling.stratified_split(labelled(spark, d))))


@query()
def m06_training_history(spark, d):
    """Loss and accuracies of each epoch until early stopping."""
    return neural.history_frame(spark, trained(spark, d)[1])


@query()
def m06_early_stopping(spark, d):
    """What the early-stopping operator reads from a real history."""
    return experiments.early_stopping(neural.history_frame(spark, trained(spark, d)[1]).withColumnRenamed("val_accuracy", "val_acc"))


def wrong_by_network(spark, d):
    """(wrong rows, their explained tokens, written once): reviews that the trained network gets wrong, as the error report wants them."""
    net, _ = trained(spark, d)
    rows = labelled(spark, d)
    explained = materialize(neural.integrated_gradients(rows, net))
    found = rows.join(explained.select("review_id", F.col("prediction").alias("net"), F.col("output").alias("sure")), "review_id").drop("confidence").withColumnRenamed("sure", "confidence")
    wrong = errors.misclassified(found, pred="net")
    return wrong, explained.join(wrong.select("review_id"), "review_id", "left_semi")


@query()
def m11_integrated_gradients(spark, d):
    """What each token of a wrong review adds to the predicted class."""
    return neural.token_rows(wrong_by_network(spark, d)[1])


@query()
def m11_completeness(spark, d):
    """Summed scores of every labelled review beside the difference that they explain."""
    explained = neural.integrated_gradients(labelled(spark, d), trained(spark, d)[0])
    return explained.select("review_id", "prediction", F.aggregate("scores", F.lit(0.0), lambda s, x: s + x).alias("explained"), (F.col("output") - F.col("baseline")).alias("difference"))


@query()
def m11_wide_top_tokens(spark, d):
    """Top and bottom tokens of each wrong review by integrated gradients."""
    return errors.wide_top_tokens(errors.top_tokens(neural.token_rows(wrong_by_network(spark, d)[1])))


@query()
def m11_contributors(spark, d):
    """Tokens that drove false positives and false negatives, by integrated gradients."""
    wrong, explained = wrong_by_network(spark, d)
    return errors.contributor_summary(neural.token_rows(explained), wrong, least=2)


@query()
def m11_token_attribution(spark, d):
    """Contributions of tokens to the predicted class of wrong rows, exact for the linear model."""
    train, every = split(spark, d)
    model = models.fit(train)
    predicted = models.score(every, model).join(every.select("review_id", "label"), "review_id").where("prediction <> label").select("review_id", "prediction")
    features = errors.token_scores(every).select("review_id", "pos", "token", F.lit(1.0).alias("value"))
    return errors.attribution(features, models.token_coefficients(model), predicted)


@query(sql("SELECT review_id, CASE WHEN pred_a = 1 THEN 1 ELSE 0 END AS predicted FROM labelled", "reviews", "labelled"))
def m02_sentiment_labels(spark, d):
    rows = labelled(spark, d).withColumn("sentiment", F.when(F.col("pred_a") == 1, "POSITIVE").otherwise("NEGATIVE"))
    return rows.select("review_id", models.label_of().alias("predicted"))
