"""Queries: time series, demand analytics and streaming."""

from pyspark.sql import functions as F

from gleanery.operators import forecasting, quality, weak_labels
from gleanery.operators import timeseries as D
from gleanery.plans.base import query, sql
from gleanery.plans.queries_text import STAGE, WORDS, L
from gleanery.sources.scratch import new_folder
from gleanery.sources.reviews import labelled, reviews, table, topical
from gleanery.streaming import ingest

BASE = ("reviews", "labelled")
TOPICAL = (*BASE, "topical")


@query(sql("SELECT count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative FROM labelled", *BASE))
def a11_overall_stats(spark, d):
    return D.overall(labelled(spark, d))


SHARES = "SELECT game_name, CASE WHEN label = 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY game_name), 6) AS percentage FROM labelled GROUP BY game_name, label"


@query(sql(SHARES, *BASE))
def a12_sentiment_shares(spark, d):
    return D.sentiment_shares(labelled(spark, d))


@query(sql(f"SELECT game_name, coalesce(max(CASE WHEN sentiment = 'POSITIVE' THEN percentage END), 0.0) AS positive, coalesce(max(CASE WHEN sentiment = 'NEGATIVE' THEN percentage END), 0.0) AS negative FROM ({SHARES}) GROUP BY 1", *BASE))
def r01_sentiment_pivot(spark, d):
    return D.sentiment_pivot(D.sentiment_shares(labelled(spark, d)))


DAY = "CAST(to_timestamp(timestamp_created) AT TIME ZONE 'UTC' AS DATE)"


def _series(interval: str):
    text = sql(f"SELECT CAST(date_trunc('{interval}', {DAY}) AS DATE) AS date, round(100.0 * count(*) FILTER (WHERE label = 1) / count(*), 6) AS positive_rate, count(*) AS review_count FROM labelled GROUP BY 1", *BASE)

    def run(spark, d):
        return D.sentiment_series(labelled(spark, d), interval)

    run.__name__ = f"a13_sentiment_by_{interval}"
    return query(text)(run)


a13_day, a13_week, a13_month = map(_series, D.INTERVALS)


@query(sql("SELECT DISTINCT game_id AS app_id, game_name FROM reviews", "reviews"))
def a14_game_list(spark, d):
    return reviews(spark, d).select(F.col("game_id").alias("app_id"), "game_name").distinct()


@query(sql("SELECT topic_id, count(*) AS mentions, round(avg(CAST(label AS DOUBLE)), 9) AS fulfilment FROM labelled JOIN (SELECT review_id, topic_id FROM topical) USING (review_id) GROUP BY 1", *TOPICAL))
def d01_d02_demand(spark, d):
    return D.demand(topical(labelled(spark, d), spark, d))


DAILY = "SELECT g.event_type, CAST(t.day AS DATE) AS date, count(e.event_id) AS n FROM (SELECT DISTINCT event_type FROM events) g CROSS JOIN (SELECT unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events)::TIMESTAMP, (SELECT max(CAST(ts AS DATE)) FROM events)::TIMESTAMP, INTERVAL 1 DAY)) AS day) t LEFT JOIN events e ON e.event_type = g.event_type AND CAST(e.ts AS DATE) = CAST(t.day AS DATE) GROUP BY 1, 2"


def daily(spark, d):
    return D.daily_series(table(spark, d, "events"), F.col("ts").cast("date"), ["event_type"])


@query(DAILY)
def d07_zero_filled_days(spark, d):
    return daily(spark, d)


@query(f"SELECT event_type, slope, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (ORDER BY slope DESC, event_type) AS INTEGER) AS rank FROM (SELECT event_type, round(regr_slope(CAST(n AS DOUBLE), CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE)), 9) AS slope, sum(n) AS n FROM ({DAILY}) GROUP BY 1)")
def d03_trend(spark, d):
    return D.trend(daily(spark, d), ["event_type"])


KIND = f"CASE WHEN {WORDS(L.BUG_CRASH)} OR {WORDS(L.DEV_CRITICISM)} THEN 'quality' WHEN {WORDS(L.DLC_MONETIZATION)} THEN 'business' ELSE 'element' END"
VOTES = f"SELECT topic_id, {KIND} AS kind, label FROM labelled JOIN (SELECT review_id, topic_id FROM topical) USING (review_id)"


@query(sql(f"SELECT topic_id, kind, votes FROM (SELECT topic_id, kind, count(*) AS votes, row_number() OVER (PARTITION BY topic_id ORDER BY count(*) DESC, kind) AS r FROM ({VOTES}) GROUP BY 1, 2) WHERE r = 1", *TOPICAL))
def d04_topic_kinds(spark, d):
    return D.topic_kinds(topical(labelled(spark, d), spark, d))


def kinds_of_reviews(spark, d):
    """Kinds of all labelled reviews. A third of them stands for the ones sorted by hand: good reviews are about elements, bad ones about quality or, where model a took them for good, business."""
    rows = labelled(spark, d)
    told = F.when(F.col("label") == 1, "element").when(F.col("pred_a") == 0, "quality").otherwise("business")
    return rows, weak_labels.review_kinds(rows, rows.where("review_id % 3 = 0").select("review_id", told.alias("kind")))[0]


@query()
def d04_review_kinds(spark, d):
    """What each labelled review is about: by hand, by rules, or by the classifier that both train."""
    return kinds_of_reviews(spark, d)[1]


@query()
def d05_unmet_by_kind(spark, d):
    """Negative reviews of each topic as unmet demand or unmet precondition, by those kinds."""
    rows, kinds = kinds_of_reviews(spark, d)
    unmet = F.when(F.col("kind") == "element", "demand").otherwise("precondition")
    return topical(rows, spark, d).where("label = 0").join(kinds, "review_id").groupBy("topic_id", unmet.alias("unmet")).agg(F.count("*").alias("n"))


@query(sql(f"SELECT topic_id, CASE WHEN kind = 'element' THEN 'demand' ELSE 'precondition' END AS unmet, count(*) AS n FROM ({VOTES}) WHERE label = 0 GROUP BY 1, 2", *TOPICAL))
def d05_unmet(spark, d):
    return D.unmet(topical(labelled(spark, d), spark, d))


@query(sql(f"""SELECT game_id, raw, n_valid, round(n_valid / raw, 6) AS pass_rate, used, span_days, round(used / span_days, 6) AS density FROM (SELECT game_id, count(*) AS raw, count(*) FILTER (WHERE v) AS n_valid FROM (SELECT *, {STAGE.format(other="'valid'")} = 'valid' AS v FROM reviews) GROUP BY 1)
    LEFT JOIN (SELECT game_id, count(*) AS used, CAST(date_diff('day', min(day), max(day)) + 1 AS BIGINT) AS span_days FROM (SELECT game_id, day, r, max(day) OVER (PARTITION BY game_id) AS latest FROM (
        SELECT game_id, {DAY} AS day, row_number() OVER (PARTITION BY game_id ORDER BY timestamp_created DESC, review_id) AS r FROM reviews WHERE {STAGE.format(other="'valid'")} = 'valid')) WHERE r <= 300 AND date_diff('day', day, latest) <= 180 GROUP BY 1) USING (game_id)""", "reviews"))
def d06_review_density(spark, d):
    return D.density(reviews(spark, d), quality.first_reason(F.col("review_text")).isNull())


@query(sql("SELECT game_id, round(avg(CAST(label AS DOUBLE)), 9) AS positive_ratio, count(*) AS n FROM labelled GROUP BY 1", *BASE))
def d08_positive_ratio(spark, d):
    return D.positive_ratio(labelled(spark, d))


@query("SELECT event_id, event_type, round(value / nullif(m, 0), 6) AS relative FROM events JOIN (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1) USING (event_type)")
def d09_relative_to_median(spark, d):
    return D.relative_to_median(table(spark, d, "events"), "event_id", "event_type", "value")


@query(sql("SELECT author, count(*) AS n, count(DISTINCT game_id) AS n_games FROM reviews GROUP BY 1 HAVING count(*) > 1", "reviews"))
def d10_repeated_authors(spark, d):
    return D.repeated_authors(reviews(spark, d))


@query(f"""SELECT event_type, CAST(date + 7 AS DATE) AS date, round(greatest(0.0, n + drift), 6) AS forecast FROM ({DAILY}) JOIN (SELECT event_type, coalesce(avg(change), 0.0) AS drift, max(date) AS hi FROM (SELECT *, n - lag(n, 7) OVER (PARTITION BY event_type ORDER BY date) AS change FROM ({DAILY})) GROUP BY 1) USING (event_type) WHERE date_diff('day', date, hi) < 7""")
def d11_forecast(spark, d):
    return D.forecast(daily(spark, d), ["event_type"])


@query()
def d11_trend_forecast(spark, d):
    """The next week of each event type by trend, change points and weekdays, with intervals."""
    return forecasting.forecast(daily(spark, d), ["event_type"])


@query()
def d11_backtest(spark, d):
    """Its error over the last week beside the seasonal naive's."""
    return forecasting.backtest(daily(spark, d), ["event_type"])


@query()
def d03_trend_slopes(spark, d):
    """Event types by the slope that the fitted trend has at the end of their series."""
    return forecasting.slopes(daily(spark, d), ["event_type"])


@query(sql("SELECT t.topic_id, mentions, CAST(coalesce(players, 0) AS BIGINT) AS players FROM (SELECT topic_id, count(*) AS mentions FROM topical GROUP BY 1) t LEFT JOIN (SELECT topic_id, sum(p_size) AS players FROM (SELECT unnest(range(0, 8)) AS topic_id, unnest(range(0, 8)) AS k) b JOIN part ON p_partkey % 11 = k GROUP BY 1) p ON p.topic_id = t.topic_id", "reviews", "topical"))
def j14_topic_players(spark, d):
    mentions = topical(reviews(spark, d), spark, d).groupBy("topic_id").agg(F.count("*").alias("mentions"))
    bridge = spark.range(8).select(F.col("id").cast("int").alias("topic_id"), F.col("id").alias("tag"))
    players = table(spark, d, "part").select(F.col("p_partkey").alias("game_id"), (F.col("p_partkey") % 11).alias("tag"), F.col("p_size").cast("long").alias("players"))
    return D.bridge_demand(mentions, bridge, players)


#: Topics are joined to event types by rank: game_id modulo their number. A snapshot is an event's value; the time axis is both tables' own.
TOPIC_TYPES = "types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT event_type FROM events)), asked AS (SELECT review_id, event_type, CAST(to_timestamp(timestamp_created) AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts FROM reviews JOIN types ON game_id % n = k)"


def typed_reviews(spark, d):
    """Reviews with the event type that their topic is joined to, and their time."""
    kinds = table(spark, d, "events").select("event_type").distinct()
    every = D.Window.partitionBy(F.lit(0))  # one row an event type
    types = kinds.select("event_type", (F.row_number().over(every.orderBy("event_type")) - 1).alias("k"), F.count("*").over(every).alias("n"))
    return reviews(spark, d).join(F.broadcast(types), F.col("game_id") % F.col("n") == F.col("k")).select("review_id", "event_type", D.moment().alias("ts"))


def snapshots(spark, d):
    return table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("players"))


@query(sql("SELECT 1", "reviews").replace(" SELECT 1", f", {TOPIC_TYPES}, shots AS (SELECT event_type, ts, max(value) AS players FROM events GROUP BY 1, 2) SELECT review_id, a.event_type, round(players, 6) AS players FROM asked a ASOF LEFT JOIN shots s ON a.event_type = s.event_type AND a.ts >= s.ts"))
def j14_mentions_as_of(spark, d):
    """Each review with the latest players of its topic's tag at that time."""
    found = D.as_of_join(typed_reviews(spark, d), snapshots(spark, d), ["event_type"], "ts", ["players"])
    return found.select("review_id", "event_type", F.round("players", 6).alias("players"))


@query(sql("SELECT 1", "reviews").replace(" SELECT 1", f""", {TOPIC_TYPES}, m AS (SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS mentions FROM asked GROUP BY 1, 2), p AS (SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS players FROM events GROUP BY 1, 2),
    s AS (SELECT event_type, date, mentions, players FROM m JOIN p USING (event_type, date))
    SELECT a.event_type, CAST(lag AS INTEGER) AS lag, count(*) AS n, CASE WHEN var_pop(CAST(a.mentions AS DOUBLE)) > 1e-12 AND var_pop(b.players) > 1e-12 THEN round(corr(CAST(a.mentions AS DOUBLE), b.players), 6) END AS correlation
    FROM s a, (SELECT unnest(range(-7, 8)) AS lag) l JOIN s b ON a.event_type = b.event_type AND b.date = CAST(a.date + CAST(lag AS INTEGER) AS DATE) GROUP BY 1, 2"""))
def j14_lag_correlation(spark, d):
    """Whether mentions of a topic run ahead of its players or behind, by lag in days."""
    mentions = typed_reviews(spark, d).groupBy("event_type", F.to_date("ts").alias("date")).agg(F.count("*").alias("mentions"))
    players = snapshots(spark, d).groupBy("event_type", F.to_date("ts").alias("date")).agg(F.avg("players").alias("players"))
    out = D.lag_correlation(mentions.join(players, ["event_type", "date"]), ["event_type"], "mentions", "players")
    return out.withColumn("correlation", F.round("correlation", 6))


@query("SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def d12_windowed_batch(spark, d):
    """The streaming aggregation over a table; a test holds the stream against it."""
    out = ingest.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def d12_windowed_stream(spark, d):
    """The same by Structured Streaming in complete mode, run over all that is there."""
    folder = new_folder(spark)
    events = ingest.read_events(spark, d, "events.parquet")
    out = ingest.run_to_table(ingest.windowed_counts(events), f"windows_{folder[-32:]}", "complete", folder)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
