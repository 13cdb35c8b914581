"""Queries: samples, splits, quotas, sets."""

from pyspark.sql import functions as F

from gleanery.functions import lexicon as L
from gleanery.functions import text as T
from gleanery.operators import sampling as S
from gleanery.plans.base import query, sql
from gleanery.plans.queries_evaluation import SPLIT
from gleanery.sources.reviews import exclusion_list, labelled, reviews, table

BASE = ("reviews", "labelled")


@query(sql("SELECT review_id, timestamp_created FROM reviews ORDER BY timestamp_created DESC, review_id LIMIT 100", "reviews"))
def s04_recent(spark, d):
    return reviews(spark, d).select("review_id", "timestamp_created").orderBy(F.desc("timestamp_created"), "review_id").limit(100)


@query(sql("SELECT review_id, game_id, label FROM labelled QUALIFY row_number() OVER (PARTITION BY game_id, label ORDER BY timestamp_created DESC, review_id) <= 50", *BASE))
def s05_balanced_reviews(spark, d):
    return S.recent_balanced(labelled(spark, d)).select("review_id", "game_id", "label")


BALANCED = """SELECT review_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(review_id || '|42'), review_id) AS r FROM {0})
    WHERE r <= {1}"""
LEAST = "(SELECT min(c) FROM (SELECT count(*) AS c FROM labelled GROUP BY label))"


@query(sql(BALANCED.format("labelled", LEAST), *BASE))
def w07_balanced(spark, d):
    return S.balanced(labelled(spark, d)).select("review_id", "label")


@query(sql(BALANCED.format("labelled", f"least(20, {LEAST})"), *BASE))
def w08_validation_set(spark, d):
    df = labelled(spark, d)
    both = df.where("label = 1").unionByName(df.where("label = 0"))
    return S.balanced(both, 20).select("review_id", "label")


@query(sql(f"SELECT review_id, split FROM ({SPLIT})", *BASE))
def w09_split_test_first(spark, d):
    return S.stratified_split(labelled(spark, d)).select("review_id", "split")


@query(sql("""SELECT review_id, CASE WHEN r <= n - k THEN 'train' WHEN r <= n - ceil(round(0.5 * k, 9)) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, ceil(round(0.3 * n, 9)) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(review_id || '|42'), review_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM labelled))""", *BASE))
def w10_split_train_first(spark, d):
    return S.stratified_split(labelled(spark, d), order="train_first").select("review_id", "split")


@query(sql("SELECT review_id, row_number() OVER (ORDER BY md5(review_id || '|42'), review_id) AS place FROM reviews", "reviews"))
def w11_shuffle(spark, d):
    rows = S.row_ids(reviews(spark, d).select("review_id"), [S.dice("review_id"), F.col("review_id")])
    return rows.select("review_id", (F.col("row_id") + 1).alias("place"))


@query(sql("SELECT game_id, CAST(5000 // n + CASE WHEN i = 1 THEN 5000 % n ELSE 0 END AS BIGINT) AS quota FROM (SELECT game_id, row_number() OVER (ORDER BY game_id) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT game_id FROM reviews))", "reviews"))
def w12_quotas(spark, d):
    return S.quotas(reviews(spark, d).select("game_id").distinct(), 5000).select("game_id", "quota")


@query(sql("SELECT game_id, n, CAST(before AS BIGINT) AS before FROM (SELECT game_id, n, coalesce(sum(n) OVER (ORDER BY game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT game_id, count(*) AS n FROM reviews GROUP BY 1)) WHERE before < 320", "reviews"))
def w13_until_target(spark, d):
    return S.until_target(reviews(spark, d).groupBy("game_id").agg(F.count("*").alias("n")), "n", 320, "game_id")


@query(sql("SELECT review_id FROM reviews QUALIFY row_number() OVER (PARTITION BY review_text ORDER BY review_id) = 1", "reviews"))
def j07_first_seen(spark, d):
    keyed = reviews(spark, d).select("review_id", T.digest(F.col("review_text")).alias("text_key"))
    return S.first_seen(keyed, ["text_key"], [F.col("review_id")]).select("review_id")


#: Games with more reviews than the mean game.
LARGE = "SELECT game_id FROM reviews GROUP BY game_id HAVING count(*) > (SELECT count(*) / count(DISTINCT game_id) FROM reviews)"


def large_games(rows):
    counts = rows.groupBy("game_id").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.avg("n").alias("mean")))).where("n > mean").select("game_id")  # one row


@query(sql(f"SELECT review_id FROM reviews WHERE game_id NOT IN ({LARGE})", "reviews"))
def j06_candidates(spark, d):
    rows = reviews(spark, d)
    return rows.join(exclusion_list(large_games(rows)), "game_id", "left_anti").select("review_id")


@query(sql(f"SELECT DISTINCT game_id FROM ({LARGE} UNION ALL SELECT game_id FROM labelled) WHERE game_id IS NOT NULL", *BASE))
def s20_exclusions(spark, d):
    return exclusion_list(large_games(reviews(spark, d)), labelled(spark, d), table(spark, d, "region"))


@query(sql("SELECT seed, base FROM (SELECT DISTINCT game_id AS seed FROM reviews), (SELECT unnest(['a', 'b']) AS base)", "reviews"))
def j12_grid(spark, d):
    from gleanery.operators.experiments import grid

    return grid(reviews(spark, d).select(F.col("game_id").alias("seed")).distinct(), spark.range(1).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("base")))


@query(sql("SELECT g.game_id, g.title, count(*) AS n FROM reviews r JOIN (SELECT DISTINCT game_id, upper(game_name) AS title FROM reviews) g ON g.game_id = r.game_id GROUP BY 1, 2", "reviews"))
def j13_game_dimension(spark, d):
    from gleanery.operators.preprocess import attach_games

    rows = reviews(spark, d)
    games = rows.select("game_id", F.upper("game_name").alias("title")).distinct()
    return attach_games(rows.select("game_id"), games).groupBy("game_id", "title").agg(F.count("*").alias("n"))


#: Tags and genres of a part stand in for those of a game.
PARTS = "SELECT p_partkey AS game_id, list_concat([p_type], string_split(p_name, ' ')) AS genres, list_distinct([p_type || ' ' || p_brand, p_name, 'size ' || p_size]) AS tags FROM part"


def part_games(spark, d):
    words = F.split("p_name", " ")
    tags = F.array_distinct(F.array(F.concat_ws(" ", "p_type", "p_brand"), F.col("p_name"), F.concat(F.lit("size "), F.col("p_size").cast("string"))))
    return table(spark, d, "part").select(F.col("p_partkey").alias("game_id"), F.array_distinct(F.concat(F.array("p_type"), words)).alias("genres"), tags.alias("tags"))


REAL = f"(SELECT game_id, list_filter(tags, lambda t: t NOT IN ({', '.join(repr(t) for t in L.NOISE_TAGS)})) AS tags FROM ({PARTS}))"


@query(f"SELECT a.game_id AS game_a, b.game_id AS game_b, count(*) AS shared FROM (SELECT game_id, unnest(tags) AS tag FROM {REAL}) a JOIN (SELECT game_id, unnest(tags) AS tag FROM {REAL}) b ON a.tag = b.tag AND a.game_id < b.game_id GROUP BY 1, 2 HAVING count(*) >= 2")
def j11_similar_games(spark, d):
    """Every two games that share two tags or more, copies too."""
    return S.similar_pairs(part_games(spark, d).select("game_id", S.without_noise(F.col("tags"), L.NOISE_TAGS).alias("tags")))


def part_reviews(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("game_id"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("label"))


@query()
def g01_diverse_games(spark, d):
    """Greedy choice among all parts with five returned and five kept line items, which stand for negative and positive reviews; a test holds it against a plain loop."""
    games = part_games(spark, d).withColumn("ordinal", F.pmod(F.xxhash64("game_id"), F.lit(1 << 40)))
    return S.select_diverse(games, complete=S.complete_groups(part_reviews(spark, d), "game_id", "label", 5)).select("game_id", F.array_join("genres", ",").alias("genres"))


@query(f"SELECT genre, count(*) AS n FROM (SELECT unnest(genres) AS genre FROM ({PARTS})) GROUP BY genre")
def a23_genre_histogram(spark, d):
    return part_games(spark, d).select(F.explode("genres").alias("genre")).groupBy("genre").agg(F.count("*").alias("n"))


@query(sql("SELECT review_id, label FROM labelled", *BASE))
def u01_union_all(spark, d):
    df = labelled(spark, d).select("review_id", "label")
    return df.where("label = 1").unionByName(df.where("label = 0"))


@query(sql(f"{LARGE} UNION SELECT game_id FROM labelled", *BASE))
def u02_set_union(spark, d):
    return large_games(reviews(spark, d)).union(labelled(spark, d).select("game_id")).distinct()


@query(f"SELECT game_id, array_to_string(list_sort(list_filter(list_distinct(genres), lambda g: g NOT IN ('SMALL', 'hot'))), ',') AS real_genres FROM ({PARTS})")
def u03_array_difference(spark, d):
    noise = F.array(F.lit("SMALL"), F.lit("hot"))
    return part_games(spark, d).select("game_id", F.array_join(F.array_sort(F.array_except("genres", noise)), ",").alias("real_genres"))


@query(f"SELECT game_id, array_to_string(list_sort(list_intersect(genres, ['ECONOMY', 'ring', 'blue'])), ',') AS shared FROM ({PARTS})")
def u04_array_intersection(spark, d):
    some = F.array(F.lit("ECONOMY"), F.lit("ring"), F.lit("blue"))
    return part_games(spark, d).select("game_id", F.array_join(F.array_sort(F.array_intersect("genres", some)), ",").alias("shared"))


@query(sql("SELECT DISTINCT game_id, language FROM reviews", "reviews"))
def u05_distinct(spark, d):
    return reviews(spark, d).select("game_id", "language").distinct()
