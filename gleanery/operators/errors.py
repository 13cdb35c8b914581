"""Error analysis: wrong rows, what changed between two models, tags of errors, and tokens that drove them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.lexicon import REPORT_ORDER


def error_type(truth: str = "label", pred: str = "pred_a") -> Column:
    return F.when((F.col(truth) == 0) & (F.col(pred) == 1), "FP").when((F.col(truth) == 1) & (F.col(pred) == 0), "FN")


def misclassified(df: DataFrame, truth: str = "label", pred: str = "pred_a") -> DataFrame:
    """Wrong rows with actual, predicted and error_type; game_name only if the input has it."""
    game = [c for c in ("game_name",) if c in df.columns]
    wrong = df.where(F.col(truth) != F.col(pred))
    return wrong.select("review_id", *game, "review_text", T.polarity(F.col(truth)).alias("actual"), T.polarity(F.col(pred)).alias("predicted"), "confidence", error_type(truth, pred).alias("error_type"))


def difference(a: DataFrame, b: DataFrame, key: str = "review_text") -> DataFrame:
    """Rows of ``a`` whose key ``b`` lacks. Null equals null; repeated rows of ``a`` stay. Keys travel as SHA-256 digests: texts are not shuffled to be compared."""
    other = b.select(T.digest(F.col(key)).alias("__k")).distinct()
    return a.withColumn("__a", T.digest(F.col(key))).join(other, F.col("__a").eqNullSafe(F.col("__k")), "left_anti").drop("__a")


def changes(before: DataFrame, after: DataFrame, key: str = "review_text") -> DataFrame:
    """Rows of both differences under ``bucket``: fixed and broke."""
    return difference(before, after, key).withColumn("bucket", F.lit("fixed")).unionByName(difference(after, before, key).withColumn("bucket", F.lit("broke")))


def change_counts(changed: DataFrame) -> DataFrame:
    """n_fixed, n_broke, net, and both by error type."""
    is_ = lambda b, t: F.count_if((F.col("bucket") == b) & (F.col("error_type") == t))
    c = changed.agg(F.count_if(F.col("bucket") == "fixed").alias("n_fixed"), F.count_if(F.col("bucket") == "broke").alias("n_broke"), *[is_(b, t).alias(f"{b}_{t.lower()}") for b in ("fixed", "broke") for t in ("FP", "FN")])
    return c.withColumn("net", F.col("n_fixed") - F.col("n_broke"))


def with_tags(df: DataFrame, text: str = "review_text") -> DataFrame:
    tagged = df.withColumn("tags", T.tags(F.col(text)))
    return tagged.withColumn("tag_count", F.size("tags"))


def tag_counts(tagged: DataFrame) -> DataFrame:
    """Reviews with each tag and their share; tags without a review are listed too."""
    names = tagged.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, REPORT_ORDER))).alias("tag"))
    counts = T.unnest(tagged, F.col("tags"), "tag").groupBy("tag").agg(F.count("*").alias("n"))
    total = tagged.agg(F.count("*").alias("total"))
    return names.join(counts, "tag", "left").crossJoin(F.broadcast(total)).select("tag", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("share"))


def tag_histogram(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy(F.col("tag_count").cast("long").alias("tag_count")).agg(F.count("*").alias("n"))


def tag_pairs(tagged: DataFrame, most: int = 10) -> DataFrame:
    """Commonest pairs of tags in one review. A review has at most 16 tags, so its pairs come from its own array, without a join."""
    pairs = T.unnest(tagged.select(F.array_sort("tags").alias("t")), F.expr("flatten(transform(t, (a, i) -> transform(slice(t, i + 2, 16), b -> struct(a as tag_a, b as tag_b))))"), "p").select("p.*")
    return pairs.groupBy("tag_a", "tag_b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag_a", "tag_b").limit(most)


def tag_error_table(tagged: DataFrame) -> DataFrame:
    return T.unnest(tagged, F.col("tags"), "tag", "error_type").groupBy("tag").agg(F.count_if(F.col("error_type") == "FP").alias("fp"), F.count_if(F.col("error_type") == "FN").alias("fn"))


def tag_rates(changed: DataFrame) -> DataFrame:
    """Share of rows of each bucket that have each tag, in percent; input: ``changes`` with tags."""
    total = changed.groupBy("bucket").agg(F.count("*").alias("total"))
    counts = T.unnest(changed, F.col("tags"), "tag", "bucket").groupBy("bucket", "tag").agg(F.count("*").alias("n"))
    return counts.join(total, "bucket").select("bucket", "tag", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("rate"))


def token_scores(df: DataFrame, score: Column | None = None) -> DataFrame:
    """(review_id, pos, token, score): tokens of every text by place from 0. Without a scorer, a fixed arithmetic stand-in."""
    rows = df.select("review_id", F.posexplode_outer(T.tokens(F.col("review_text"))).alias("pos", "token")).where("token is not null")
    stand_in = (F.pmod(F.length("token") * 31 + F.col("pos") * 17 + F.col("review_id"), F.lit(200)) - 100) / F.lit(100.0)
    return rows.withColumn("score", score if score is not None else stand_in)


def top_tokens(scores: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` highest and lowest scores of each review as ranked rows (review_id, side, rank, token, score); ties by place."""
    w = Window.partitionBy("review_id")
    high = scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "pos"))).where(F.col("rank") <= n).withColumn("side", F.lit("pos"))
    low = scores.withColumn("rank", F.row_number().over(w.orderBy("score", "pos"))).where(F.col("rank") <= n).withColumn("side", F.lit("neg"))
    return high.unionByName(low).select("review_id", "side", "rank", "token", "score")


def wide_top_tokens(top: DataFrame, n: int = 5) -> DataFrame:
    """One row a review: pos1_token, pos1_score to neg5_score; null where a text is short."""
    pick = lambda s, r, c: F.max(F.when((F.col("side") == s) & (F.col("rank") == r), F.col(c))).alias(f"{s}{r}_{c}")
    return top.groupBy("review_id").agg(*[pick(s, r, c) for s in ("pos", "neg") for r in range(1, n + 1) for c in ("token", "score")])


def token_aggregate(scores: DataFrame, least: int = 5, most: int = 20, ascending: bool = False) -> DataFrame:
    """Tokens by mean score among those seen ``least`` times; ties by token."""
    rows = scores.groupBy("token").agg(F.sum("score").alias("total"), F.count("*").alias("n")).where(F.col("n") >= least)
    rows = rows.withColumn("mean", F.round(F.col("total") / F.col("n"), 9)).withColumn("total", F.round("total", 6))
    return rows.orderBy(F.col("mean").asc() if ascending else F.col("mean").desc(), "token").limit(most)


def contributor_summary(scores: DataFrame, errors: DataFrame, least: int = 5, most: int = 20) -> DataFrame:
    """Tokens that push false positives up (fp_positive) and false negatives down (fn_negative), meaningful tokens only."""
    kept = scores.join(errors.select("review_id", "error_type"), "review_id").where(T.meaningful(F.col("token")))
    up = token_aggregate(kept.where("error_type = 'FP' and score > 0"), least, most).withColumn("side", F.lit("fp_positive"))
    down = token_aggregate(kept.where("error_type = 'FN' and score < 0"), least, most, True).withColumn("side", F.lit("fn_negative"))
    return up.unionByName(down)


def attribution(features: DataFrame, coefficients: DataFrame, predicted: DataFrame) -> DataFrame:
    """(review_id, pos, token, score): contribution of each token to the predicted class of a linear model, coefficient times value, by joins."""
    sign = F.when(F.col("prediction") == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    return features.join(coefficients, "token").join(predicted, "review_id").select("review_id", "pos", "token", (sign * F.col("coefficient") * F.col("value")).alias("score"))
