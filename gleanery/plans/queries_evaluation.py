"""Queries: metrics, comparisons and statistics of classifiers."""

from pyspark.sql import functions as F

from gleanery.functions import stats
from gleanery.operators import evaluation as E
from gleanery.operators import sampling
from gleanery.plans.base import query, sql
from gleanery.sources.reviews import labelled

BASE = ("reviews", "labelled")
SURE = lambda c: f"CAST({c} AS BIGINT)"
COUNTS = lambda p: ", ".join(f"count(*) FILTER (WHERE label = {y} AND {p} = {q}) AS {n}" for n, y, q in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))
DIV = lambda a, b: f"CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / ({b}) END"
METRICS = lambda p, by="": f"""SELECT *, {DIV('2 * precision * recall', 'precision + recall')} AS f1 FROM (SELECT *, {DIV('tp + tn', 'tp + tn + fp + fn')} AS accuracy,
    {DIV('tp', 'tp + fp')} AS precision, {DIV('tp', 'tp + fn')} AS recall FROM (SELECT {by + ', ' if by else ''}{COUNTS(p)} FROM labelled{' GROUP BY ' + by if by else ''}))"""  # noqa: E731
ROUNDED = ["accuracy", "precision", "recall", "f1"]
ROUND = lambda inner, keep="tn, fp, fn, tp": f"SELECT {keep}, {', '.join(f'round({c}, 9) AS {c}' for c in ROUNDED)} FROM ({inner})"


def rounded(df, names=ROUNDED, digits=9):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(sql("SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labelled GROUP BY label", *BASE))
def a01_label_counts(spark, d):
    return E.label_shares(labelled(spark, d))


SPLIT = """SELECT *, CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil(round(0.17647058823529413 * (n - t), 9)) THEN 'validation' ELSE 'train' END AS split FROM (
    SELECT *, ceil(round(0.15 * n, 9)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(review_id || '|42'), review_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM labelled))"""


@query(sql(f"SELECT split, count(*) AS total, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative, round(count(*) FILTER (WHERE label = 1) / count(*), 6) AS positive_share, round(count(*) FILTER (WHERE label = 0) / count(*), 6) AS negative_share FROM ({SPLIT}) GROUP BY split", *BASE))
def a02_split_statistics(spark, d):
    return E.split_statistics(sampling.stratified_split(labelled(spark, d)))


@query(sql(ROUND(METRICS("pred_a")), *BASE))
def a03_metrics(spark, d):
    return rounded(E.metrics(labelled(spark, d)))


@query(sql(ROUND(METRICS("pred_b", "game_name"), "game_name, tn, fp, fn, tp"), *BASE))
def a03_metrics_by_game(spark, d):
    return rounded(E.metrics(labelled(spark, d), pred="pred_b", by=["game_name"]))


CLASSES = lambda p: f"SELECT CASE WHEN label = 1 THEN 'positive' ELSE 'negative' END AS class, count(*) FILTER (WHERE label = {p}) AS correct, count(*) AS total FROM labelled GROUP BY label"


@query(sql(f"SELECT *, round(correct / total, 9) AS accuracy FROM ({CLASSES('pred_a')})", *BASE))
def a04_per_class(spark, d):
    return rounded(E.per_class(labelled(spark, d)), ["accuracy"])


REPORT = f"""SELECT class, round({DIV('hit', 'said')}, 9) AS precision, round({DIV('hit', 'support')}, 9) AS recall, {DIV('hit', 'said')} AS p, {DIV('hit', 'support')} AS r, support FROM (
    SELECT 'negative' AS class, tn AS hit, tn + fn AS said, tn + fp AS support FROM (SELECT {COUNTS('pred_b')} FROM labelled)
    UNION ALL SELECT 'positive', tp, tp + fp, tp + fn FROM (SELECT {COUNTS('pred_b')} FROM labelled))"""


@query(sql(f"""SELECT class, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1, CAST(support AS BIGINT) AS support FROM (
    WITH c AS (SELECT *, {DIV('2 * p * r', 'p + r')} AS f FROM ({REPORT})) SELECT class, p, r, f, support FROM c
    UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM c
    UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM c)""", *BASE))
def a05_report(spark, d):
    return rounded(E.report(labelled(spark, d), pred="pred_b"), ["precision", "recall", "f1"])


@query(sql("SELECT count(*) AS n_errors, round(avg(confidence), 9) AS mean_confidence, count(*) FILTER (WHERE confidence >= 0.9) AS high_confidence FROM labelled WHERE label <> pred_a", *BASE))
def a06_error_confidence(spark, d):
    return E.error_summary(labelled(spark, d))


@query(sql(f"""SELECT game_name, round(accuracy, 9) AS accuracy, CASE WHEN accuracy >= 0.90 THEN 'excellent' WHEN accuracy >= 0.85 THEN 'good' WHEN accuracy >= 0.80 THEN 'acceptable' ELSE 'poor' END AS english,
    CASE WHEN accuracy >= 0.85 THEN 'excellent' WHEN accuracy >= 0.80 THEN 'acceptable' ELSE 'poor' END AS japanese, CASE WHEN accuracy >= 0.90 THEN 'pass' WHEN accuracy >= 0.85 THEN 'tolerable' ELSE 'fail' END AS verdict FROM ({METRICS('pred_a', 'game_name')})""", *BASE))
def a25_grades(spark, d):
    acc = F.col("accuracy")
    return E.metrics(labelled(spark, d), by=["game_name"]).select("game_name", F.round(acc, 9).alias("accuracy"), E.grade(acc, "english").alias("english"), E.grade(acc, "japanese").alias("japanese"), E.validation_verdict(acc).alias("verdict"))


@query(sql(f"""SELECT m AS metric, round(a, 9) AS a, round(b, 9) AS b, round(a - b, 9) AS delta FROM (
    {' UNION ALL '.join(f"SELECT '{n}' AS m, x.{n} AS a, y.{n} AS b FROM ({METRICS('pred_a')}) x, ({METRICS('pred_b')}) y" for n in ROUNDED)})""", *BASE))
def a26_metric_deltas(spark, d):
    df = labelled(spark, d)
    return rounded(E.deltas(E.metrics(df), E.metrics(df, pred="pred_b"), ROUNDED), ["a", "b", "delta"])


PAIRED = "count(*) FILTER (WHERE pred_a = label AND pred_b <> label) AS only_a, count(*) FILTER (WHERE pred_a <> label AND pred_b = label) AS only_b"
#: Exact binomial tail by log gamma, for (only_a, only_b).
MCNEMAR = """SELECT *, only_a + only_b AS discordant, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1),
    lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) END, 6) AS p_value FROM ({0})"""


@query(sql(f"SELECT *, p_value < 0.05 AS significant FROM ({MCNEMAR.format(f'SELECT {PAIRED} FROM labelled')})", *BASE))
def e01_mcnemar(spark, d):
    return rounded(E.mcnemar(labelled(spark, d), "pred_a", "pred_b"), ["p_value"], 6)


@query(sql(MCNEMAR.format(f"SELECT game_id, language, {PAIRED} FROM labelled GROUP BY game_id, language"), *BASE))
def e01_mcnemar_grid(spark, d):
    """The exact test in every cell of game and language."""
    wins = lambda a, b: F.count_if((F.col(a) == F.col("label")) & (F.col(b) != F.col("label")))
    cells = labelled(spark, d).groupBy("game_id", "language").agg(wins("pred_a", "pred_b").alias("only_a"), wins("pred_b", "pred_a").alias("only_b"))
    return cells.select("*", (F.col("only_a") + F.col("only_b")).alias("discordant"), F.round(stats.mcnemar_p(F.col("only_a"), F.col("only_b")), 6).alias("p_value"))


THREE = [("pred_a", "pred_b"), ("pred_a", "pred_c"), ("pred_b", "pred_c")]


@query(sql(f"SELECT *, p_value < 0.05 AS significant FROM ({MCNEMAR.format(' UNION ALL '.join(f'''SELECT '{a}' AS model_a, '{b}' AS model_b, count(*) FILTER (WHERE {a} = label AND {b} <> label) AS only_a, count(*) FILTER (WHERE {a} <> label AND {b} = label) AS only_b FROM (SELECT *, review_id % 2 AS pred_c FROM labelled)''' for a, b in THREE))})", *BASE))
def j09_model_pairs(spark, d):
    df = labelled(spark, d).withColumn("pred_c", (F.col("review_id") % 2).cast("int"))
    return rounded(E.compare_all(df, ["pred_a", "pred_b", "pred_c"]), ["p_value"], 6)


@query(sql("SELECT a.review_id, a.label, a.pred_a, b.pred_b FROM labelled a JOIN labelled b USING (review_id)", *BASE))
def j08_zip_predictions(spark, d):
    df = labelled(spark, d)
    return df.select("review_id", "label", "pred_a").join(df.select("review_id", "pred_b"), "review_id")


LOGITS = "[(review_id % 7) / 2.0, (review_id % 5) / 1.5]"


@query(sql(f"SELECT review_id, CAST(CASE WHEN a >= b THEN 0 ELSE 1 END AS INTEGER) AS predicted, round(exp(greatest(a, b)) / (exp(a) + exp(b)), 9) AS confidence FROM (SELECT review_id, CAST(review_id % 7 AS DOUBLE) / 2 AS a, CAST(review_id % 5 AS DOUBLE) / 1.5 AS b FROM labelled)", *BASE))
def e06_softmax(spark, d):
    logits = F.array(F.col("review_id") % 7 / F.lit(2.0), F.col("review_id") % 5 / F.lit(1.5))
    p = labelled(spark, d).select("review_id", stats.softmax(logits).alias("p"))
    return p.select("review_id", stats.argmax(F.col("p")).alias("predicted"), F.round(F.array_max("p"), 9).alias("confidence"))


@query(sql("SELECT round(avg(-ln(CASE WHEN label = pred_a THEN confidence ELSE 1 - confidence END)), 6) AS loss FROM labelled", *BASE))
def e07_cross_entropy(spark, d):
    truth = F.when(F.col("label") == F.col("pred_a"), F.col("confidence")).otherwise(1 - F.col("confidence"))
    return labelled(spark, d).agg(F.round(stats.cross_entropy(truth), 6).alias("loss"))


@query(sql(f"SELECT split, round(100 * accuracy, 6) AS accuracy FROM (SELECT split, {DIV('count(*) FILTER (WHERE label = pred_a)', 'count(*)')} AS accuracy FROM ({SPLIT}) GROUP BY split)", *BASE))
def m13_run_metrics(spark, d):
    return E.metrics(sampling.stratified_split(labelled(spark, d)), by=["split"]).select("split", F.round(100 * F.col("accuracy"), 6).alias("accuracy"))


@query(sql("SELECT metric, round(value, 9) AS value, model FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS metric, {n} AS value, '{m}' AS model FROM ({METRICS(m)})" for m in ("pred_a", "pred_b") for n in ROUNDED) + ")", *BASE))
def r04_long_metrics(spark, d):
    from gleanery.operators.experiments import long_metrics

    df = labelled(spark, d)
    both = E.metrics(df).withColumn("model", F.lit("pred_a")).unionByName(E.metrics(df, pred="pred_b").withColumn("model", F.lit("pred_b")))
    return long_metrics(both, ["model"], ROUNDED).withColumn("value", F.round("value", 9))
