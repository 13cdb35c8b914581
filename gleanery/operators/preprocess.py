"""From raw reviews to clean ones, and texts without their game's name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.sources.reviews import require_columns


def clean_reviews(raw: DataFrame) -> DataFrame:
    """Raw reviews renamed, cleaned and without those whose text is empty after cleaning; an empty input gives a typed empty frame."""
    require_columns(raw, "review_text", "voted_up", "votes_up", "language", "timestamp_created", "author")
    return raw.select(
        T.clean_text(F.col("review_text")).alias("review_text"), F.when(F.col("voted_up"), 1).otherwise(0).alias("game_rating"), F.col("votes_up").cast("int").alias("review_helpfulness"),
        "language", F.col("timestamp_created").alias("posted_date"), F.col("author").alias("user_id"),
    ).where("review_text <> ''")


def remove_game_names(df: DataFrame, text: str = "review_text", game: str = "game_name") -> DataFrame:
    """Each text without the words of its game's title, which are read from the row's own title: texts are not shuffled, so a game of any number of rows
    loads no task. A null game leaves the text as it is."""
    return df.withColumn(text, T.let(F.struct(F.col(text).alias("text"), T.title_words(F.col(game)).alias("words")), lambda v: T.remove_words(v["text"], v["words"])))


def attach_games(df: DataFrame, games: DataFrame, key: str = "game_id") -> DataFrame:
    """Columns of a game dimension by key; Spark broadcasts it while it is small."""
    return df.join(games, key)
