"""Sentiment and mentions over time, and demand analytics by topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.sampling import ranks

from gleanery.functions import text as T
from gleanery.functions import lexicon as L

INTERVALS = ("day", "week", "month")


def moment(seconds: str = "timestamp_created") -> Column:
    return F.timestamp_seconds(F.col(seconds))


def overall(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))


def sentiment_shares(df: DataFrame, by: str = "game_name") -> DataFrame:
    """(game, sentiment, count, percentage): each sentiment's share of its game's reviews."""
    counts = df.groupBy(by, F.when(F.col("label") == 1, "POSITIVE").otherwise("NEGATIVE").alias("sentiment")).agg(F.count("*").alias("count"))
    return counts.withColumn("percentage", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy(by)), 6))


def sentiment_pivot(shares: DataFrame, by: str = "game_name") -> DataFrame:
    wide = shares.groupBy(by).pivot("sentiment", ["POSITIVE", "NEGATIVE"]).agg(F.first("percentage"))
    return wide.select(by, F.coalesce("POSITIVE", F.lit(0.0)).alias("positive"), F.coalesce("NEGATIVE", F.lit(0.0)).alias("negative"))


def sentiment_series(df: DataFrame, interval: str = "week") -> DataFrame:
    """(date, positive_rate, review_count) by day, week from Monday, or month."""
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {INTERVALS}")
    c = df.groupBy(F.date_trunc(interval, moment()).cast("date").alias("date")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count("*").alias("review_count"))
    return c.select("date", F.round(100.0 * F.col("p") / F.col("review_count"), 6).alias("positive_rate"), "review_count")


def daily_series(df: DataFrame, day: Column, by: list[str]) -> DataFrame:
    """Rows a day for each group, days without rows as 0, from the first day of all to the last."""
    rows = df.select(*by, day.alias("date"))
    span = rows.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("date"))
    frame = rows.select(*by).distinct().crossJoin(F.broadcast(days))  # a row for each group and day: the result itself
    counts = rows.groupBy(*by, "date").agg(F.count("*").alias("n"))
    return frame.join(counts, [*by, "date"], "left").select(*by, "date", F.coalesce("n", F.lit(0)).alias("n"))


def trend(series: DataFrame, by: list[str]) -> DataFrame:
    """Slope of daily counts, and its rank; a topic that rises early ranks first."""
    x = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("double")
    slopes = series.groupBy(*by).agg(F.round(F.regr_slope(F.col("n").cast("double"), x), 9).alias("slope"), F.sum("n").alias("n"))
    return slopes.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("slope"), *by)))


def demand(df: DataFrame) -> DataFrame:
    """(topic_id, mentions, fulfilment): absolute mentions and the positive rate of each topic."""
    return df.groupBy("topic_id").agg(F.count("*").alias("mentions"), F.round(F.avg(F.col("label").cast("double")), 9).alias("fulfilment"))


def topic_kind(text: Column) -> Column:
    """What a review's complaint is about: quality and operations (defects, how the makers act), business (price and payment), or a game element."""
    low = F.lower(F.coalesce(text, F.lit("")))
    quality = T.contains_any(low, L.BUG_CRASH) | T.contains_any(low, L.DEV_CRITICISM)
    return F.when(quality, "quality").when(T.contains_any(low, L.DLC_MONETIZATION), "business").otherwise("element")


def topic_kinds(df: DataFrame) -> DataFrame:
    """The kind most reviews of a topic vote for, ties by name."""
    votes = df.groupBy("topic_id", topic_kind(F.col("review_text")).alias("kind")).agg(F.count("*").alias("votes"))
    return votes.withColumn("r", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("votes"), "kind"))).where("r = 1").drop("r")


def unmet(df: DataFrame) -> DataFrame:
    """Negative reviews of each topic as unmet demand (elements) or unmet precondition (quality, business)."""
    kind = F.when(topic_kind(F.col("review_text")) == "element", "demand").otherwise("precondition")
    return df.where("label = 0").groupBy("topic_id", kind.alias("unmet")).agg(F.count("*").alias("n"))


def density(df: DataFrame, valid: Column, most: int = 300, days: int = 180) -> DataFrame:
    """By game: raw and valid reviews, pass rate, and valid reviews a day within the latest ``most`` valid ones and ``days`` days."""
    rows = df.withColumn("valid", valid).withColumn("day", moment().cast("date"))
    totals = rows.groupBy("game_id").agg(F.count("*").alias("raw"), F.count_if("valid").alias("n_valid"), F.max(F.when(F.col("valid"), F.col("day"))).alias("latest"))
    ranked = rows.where("valid").withColumn("r", F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc("timestamp_created"), "review_id"))).where(F.col("r") <= most)
    within = ranked.join(totals.select("game_id", "latest"), "game_id").where(F.datediff("latest", "day") <= days)
    spans = within.groupBy("game_id").agg(F.count("*").alias("used"), (F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("span_days"))
    return totals.join(spans, "game_id", "left").select("game_id", "raw", "n_valid", F.round(F.col("n_valid") / F.col("raw"), 6).alias("pass_rate"), "used", "span_days", F.round(F.col("used") / F.col("span_days"), 6).alias("density"))


def positive_ratio(df: DataFrame) -> DataFrame:
    return df.groupBy("game_id").agg(F.round(F.avg(F.col("label").cast("double")), 9).alias("positive_ratio"), F.count("*").alias("n"))


def relative_to_median(df: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """Each value over its group's exact median; null for a zero median. Values are ranked by ranges, so no task holds a group's values."""
    placed = ranks(df.where(F.col(value).isNotNull()).select(group, value), group, [F.col(value)])
    middle = placed.where(F.abs(2 * F.col("__r") - F.col("__n") - 1) <= 1)
    medians = middle.groupBy(group).agg(F.avg(F.col(value).cast("double")).alias("median"))
    return df.join(medians, group).select(key, group, F.round(F.col(value) / F.nullif(F.col("median"), F.lit(0.0)), 6).alias("relative"))


def repeated_authors(df: DataFrame) -> DataFrame:
    return df.groupBy("author").agg(F.count("*").alias("n"), F.countDistinct("game_id").alias("n_games")).where("n > 1")


def forecast(series: DataFrame, by: list[str], season: int = 7) -> DataFrame:
    """The next ``season`` days of each group: the same weekday's last value plus the mean change from one season to the next."""
    w = Window.partitionBy(*by).orderBy("date")
    back = series.withColumn("change", F.col("n") - F.lag("n", season).over(w)).withColumn("left", F.datediff(F.max("date").over(Window.partitionBy(*by)), "date"))
    drift = back.groupBy(*by).agg(F.coalesce(F.avg("change"), F.lit(0.0)).alias("drift"))
    last = back.where(F.col("left") < season).join(drift, by)
    return last.select(*by, F.date_add("date", season).alias("date"), F.round(F.greatest(F.lit(0.0), F.col("n") + F.col("drift")), 6).alias("forecast"))


def bridge_demand(mentions: DataFrame, bridge: DataFrame, players: DataFrame) -> DataFrame:
    """(topic_id, mentions, players): demand of a topic beside the players of games that carry its tag; bridge: topic_id, tag; players: game_id, tag, players."""
    own = bridge.join(players, "tag").groupBy("topic_id").agg(F.sum("players").alias("players"))
    return mentions.join(own, "topic_id", "left").select("topic_id", "mentions", F.coalesce("players", F.lit(0)).alias("players"))


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], time: str, values: list[str], bucket: str = "day") -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` (by, time, values) at or before each row's ``time``; null where there is none.

    Both sides are dealt by key and ``bucket`` of the time, so a key of any size is many tasks; the last row of each bucket is carried to those
    after it over one row a bucket. Of right rows of one key and time the one with the largest values counts. Rows with a null key or time stay, without values."""
    own = F.struct(*[F.col(v) for v in values])
    slot = F.date_trunc(bucket, F.col(time))
    seen = right.where(F.col(time).isNotNull()).select(*by, F.col(time), slot.alias("__b"), own.alias("__v"), F.lit(1).alias("__right"))
    asked = left.withColumn("__b", slot).withColumn("__right", F.lit(0))
    # the last value of each bucket, carried into those after it: one row a key and bucket that either side has
    last = seen.groupBy(*by, "__b").agg(F.max(F.struct(time, "__v")).alias("__last"))
    frame = last.unionByName(asked.where(F.col("__b").isNotNull()).select(*by, "__b").distinct(), allowMissingColumns=True).groupBy(*by, "__b").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = frame.select(*by, "__b", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    fields = [c for c in left.columns if c not in (*by, time)]
    both = asked.select(*by, F.col(time), "__b", "__right", F.struct(*fields, F.lit(0).alias("__")).alias("__row")).unionByName(seen, allowMissingColumns=True)
    within = Window.partitionBy(*by, "__b").orderBy(F.col(time), F.desc("__right"), F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__now", F.last("__v", ignorenulls=True).over(within)).where("__right = 0")
    out = found.join(carried, [*by, "__b"], "left").withColumn("__now", F.coalesce("__now", "__carried.__v"))
    return out.select(*by, time, *[F.col(f"__row.{c}").alias(c) for c in fields], *[F.col(f"__now.{v}").alias(v) for v in values])


def lag_correlation(series: DataFrame, by: list[str], a: str, b: str, most: int = 7, date: str = "date") -> DataFrame:
    """(by, lag, n, correlation): ``a`` of each day with ``b`` that many days later, for lags from -``most`` to ``most``; a lag above 0 says that ``a`` runs ahead. Null
    without spread. Each row goes out once for each lag: 2 * ``most`` + 1 times, whatever the series."""
    ahead = series.select(*by, F.col(date), F.col(a).cast("double").alias("__a"), F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"))
    later = series.select(*by, F.col(date).alias("__d"), F.col(b).cast("double").alias("__b"))
    pairs = ahead.withColumn("__d", F.date_add(date, F.col("lag"))).join(later, [*by, "__d"]).where("__a is not null and __b is not null")
    spread = lambda c: F.when(F.var_pop(c) > 1e-12, F.stddev_pop(c))
    return pairs.groupBy(*by, "lag").agg(F.count("*").alias("n"), (F.covar_pop("__a", "__b") / (spread("__a") * spread("__b"))).alias("correlation"))
