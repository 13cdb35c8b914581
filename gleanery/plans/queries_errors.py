"""Queries: error analysis."""

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions import lexicon as L
from gleanery.operators import errors as X
from gleanery.plans.base import query, sql
from gleanery.plans.queries_text import STOP, TAG_LIST, TOKENS, lit
from gleanery.sources.reviews import labelled

A = ("reviews", "labelled", "errs_a")
AB = (*A, "errs_b", "changed")
SCORED = (*A, "tok", "scored")
TAGGED = f"SELECT *, {TAG_LIST} AS tags FROM (SELECT *, {TOKENS} FROM errs_a)"


def errors_of(spark, d, pred="pred_a"):
    return X.misclassified(labelled(spark, d), pred=pred)


def tagged_errors(spark, d):
    return X.with_tags(errors_of(spark, d))


@query(sql("SELECT review_id, game_name, CASE WHEN label = 1 THEN 'P' ELSE 'N' END AS actual, CASE WHEN pred_a = 1 THEN 'P' ELSE 'N' END AS predicted, round(confidence, 9) AS confidence, error_type FROM errs_a", *A))
def w01_misclassified(spark, d):
    return errors_of(spark, d).orderBy(F.desc("confidence"), "review_id").drop("review_text").withColumn("confidence", F.round("confidence", 9))


@query(sql("SELECT review_id, bucket, error_type FROM changed WHERE bucket = 'fixed'", *AB))
def j04_fixed(spark, d):
    return X.difference(errors_of(spark, d), errors_of(spark, d, "pred_b")).select("review_id", F.lit("fixed").alias("bucket"), "error_type")


@query(sql("SELECT n_fixed, n_broke, n_fixed - n_broke AS net FROM (SELECT count(*) FILTER (WHERE bucket = 'fixed') AS n_fixed, count(*) FILTER (WHERE bucket = 'broke') AS n_broke FROM changed)", *AB))
def j05_broke_and_net(spark, d):
    return X.change_counts(X.changes(errors_of(spark, d), errors_of(spark, d, "pred_b"))).select("n_fixed", "n_broke", "net")


@query(sql("SELECT " + ", ".join(f"count(*) FILTER (WHERE bucket = '{b}' AND error_type = '{t}') AS {b}_{t.lower()}" for b in ("fixed", "broke") for t in ("FP", "FN")) + " FROM changed", *AB))
def e10_change_types(spark, d):
    return X.change_counts(X.changes(errors_of(spark, d), errors_of(spark, d, "pred_b"))).select("fixed_fp", "fixed_fn", "broke_fp", "broke_fn")


@query(sql(f"SELECT bucket, tag, round(100.0 * count(*) / any_value(n), 6) AS rate FROM (SELECT bucket, n, unnest(tags) AS tag FROM (SELECT *, {TAG_LIST} AS tags, count(*) OVER (PARTITION BY bucket) AS n FROM (SELECT *, {TOKENS} FROM changed))) GROUP BY bucket, tag", *AB))
def e09_tag_rates(spark, d):
    changed = X.changes(errors_of(spark, d), errors_of(spark, d, "pred_b"))
    return X.tag_rates(X.with_tags(changed))


@query(sql(f"SELECT x.tag, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM ({TAGGED})), 6) AS share FROM (SELECT unnest([{', '.join(map(lit, L.TAGS))}]) AS tag) x LEFT JOIN (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM ({TAGGED})) GROUP BY tag) y ON x.tag = y.tag", *A))
def a09_tag_counts(spark, d):
    return X.tag_counts(tagged_errors(spark, d))


@query(sql(f"SELECT CAST(len(tags) AS BIGINT) AS tag_count, count(*) AS n FROM ({TAGGED}) GROUP BY 1", *A))
def a10_tag_histogram(spark, d):
    return X.tag_histogram(tagged_errors(spark, d))


@query(sql(f"SELECT a AS tag_a, b AS tag_b, count(*) AS n FROM (SELECT review_id, unnest(tags) AS a FROM ({TAGGED})) x JOIN (SELECT review_id, unnest(tags) AS b FROM ({TAGGED})) y USING (review_id) WHERE a < b GROUP BY a, b ORDER BY n DESC, a, b LIMIT 10", *A))
def j10_tag_pairs(spark, d):
    return X.tag_pairs(tagged_errors(spark, d))


@query(sql(f"SELECT a || '+' || b AS pair, count(*) AS n FROM (SELECT review_id, unnest(tags) AS a FROM ({TAGGED})) x JOIN (SELECT review_id, unnest(tags) AS b FROM ({TAGGED})) y USING (review_id) WHERE a < b GROUP BY a, b ORDER BY n DESC, a, b LIMIT 3", *A))
def w05_most_common(spark, d):
    return X.tag_pairs(tagged_errors(spark, d), 3).select(F.concat_ws("+", "tag_a", "tag_b").alias("pair"), "n")


@query(sql(f"SELECT tag, count(*) FILTER (WHERE error_type = 'FP') AS fp, count(*) FILTER (WHERE error_type = 'FN') AS fn FROM (SELECT error_type, unnest(tags) AS tag FROM ({TAGGED})) GROUP BY tag", *A))
def a22_tag_error_table(spark, d):
    return X.tag_error_table(tagged_errors(spark, d))


@query(sql(f"SELECT review_id FROM ({TAGGED}) WHERE list_contains(tags, 'long_text')", *A))
def u07_rows_with_tag(spark, d):
    return tagged_errors(spark, d).where(F.array_contains("tags", "long_text")).select("review_id")


@query(sql("SELECT count(DISTINCT review_id) AS n_reviews FROM scored", *SCORED))
def a15_distinct_reviews(spark, d):
    return X.token_scores(errors_of(spark, d)).agg(F.countDistinct("review_id").alias("n_reviews"))


AGG = "SELECT token, round(sum(score), 6) AS total, count(*) AS n, round(sum(score) / count(*), 9) AS mean FROM {0} GROUP BY token HAVING count(*) >= 5 ORDER BY mean {1}, token LIMIT 20"


@query(sql(AGG.format("scored", "DESC"), *SCORED))
def a16_token_aggregate(spark, d):
    return X.token_aggregate(X.token_scores(errors_of(spark, d)))


GOOD = f"length(token) >= 3 AND token NOT IN ({STOP}) AND regexp_matches(token, '[a-z]')"
SIDE = lambda t, op: f"(SELECT s.token, s.score FROM scored s JOIN errs_a USING (review_id) WHERE error_type = '{t}' AND score {op} 0 AND {GOOD})"


@query(sql(f"SELECT *, 'fp_positive' AS side FROM ({AGG.format(SIDE('FP', '>'), 'DESC')}) UNION ALL SELECT *, 'fn_negative' FROM ({AGG.format(SIDE('FN', '<'), 'ASC')})", *SCORED))
def a17_contributors(spark, d):
    wrong = errors_of(spark, d)
    return X.contributor_summary(X.token_scores(wrong), wrong)


RANKED = """SELECT review_id, 'pos' AS side, rank, token, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY review_id ORDER BY score DESC, pos) AS INTEGER) AS rank FROM scored) WHERE rank <= 5
    UNION ALL SELECT review_id, 'neg', rank, token, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY review_id ORDER BY score, pos) AS INTEGER) AS rank FROM scored) WHERE rank <= 5"""


@query(sql(f"SELECT * FROM ({RANKED}) WHERE side = 'pos'", *SCORED))
def w02_top_positive(spark, d):
    return X.top_tokens(X.token_scores(errors_of(spark, d))).where("side = 'pos'")


@query(sql(f"SELECT * FROM ({RANKED}) WHERE side = 'neg'", *SCORED))
def w03_bottom_negative(spark, d):
    return X.top_tokens(X.token_scores(errors_of(spark, d))).where("side = 'neg'")


WIDE = "SELECT review_id, " + ", ".join(f"max(CASE WHEN side = '{s}' AND rank = {r} THEN {c} END) AS {s}{r}_{c}" for s in ("pos", "neg") for r in range(1, 6) for c in ("token", "score")) + f" FROM ({RANKED}) GROUP BY review_id"


@query(sql(WIDE, *SCORED))
def r03_wide_top_tokens(spark, d):
    return X.wide_top_tokens(X.top_tokens(X.token_scores(errors_of(spark, d))))


@query(sql(f"SELECT e.review_id, error_type, pos1_token, neg1_token FROM errs_a e JOIN ({WIDE}) w ON w.review_id = e.review_id", *SCORED))
def j01_errors_with_top_words(spark, d):
    wrong = errors_of(spark, d)
    return wrong.join(X.wide_top_tokens(X.top_tokens(X.token_scores(wrong))), "review_id").select("review_id", "error_type", "pos1_token", "neg1_token")


@query(sql("SELECT s.review_id, pos, token, score, error_type FROM scored s LEFT JOIN errs_a e ON e.review_id = s.review_id", *SCORED))
def j02_scores_with_error_type(spark, d):
    wrong = errors_of(spark, d)
    return X.token_scores(wrong).join(wrong.select("review_id", "error_type"), "review_id", "left")


@query(sql("SELECT s.review_id, pos, token, score, round(confidence, 9) AS confidence FROM scored s LEFT JOIN errs_a e ON e.review_id = s.review_id ORDER BY confidence DESC, score DESC, s.review_id, pos", *SCORED))
def j03_scores_sorted(spark, d):
    wrong = errors_of(spark, d)
    rows = X.token_scores(wrong).join(wrong.select("review_id", F.round("confidence", 9).alias("confidence")), "review_id", "left")
    return rows.orderBy(F.desc("confidence"), F.desc("score"), "review_id", "pos")
