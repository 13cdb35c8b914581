"""Review schemas, readers and sinks, and the driver tables seen as reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_REVIEW = "review_text string, voted_up boolean, votes_up int, language string, timestamp_created bigint, author string"
CLEAN_REVIEW = "review_text string, game_rating int, review_helpfulness int, language string, posted_date bigint, user_id string"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str | None = None, na_literals: tuple[str, ...] = (), multi_line: bool = True) -> DataFrame:
    """CSV with doubled quotes and, if ``multi_line``, quoted line breaks (each file is then one task; without them files are split).
    Texts in ``na_literals`` become null; by default none do."""
    reader = spark.read.options(header=True, multiLine=multi_line, escape='"')
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if na_literals:
        df = df.select(*[F.when(~F.col(n).isin(*na_literals), F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes])
    return df


def read_json(spark: SparkSession, path: str, schema: str = RAW_REVIEW, multi_line: bool = True) -> DataFrame:
    """Files that hold one list of reviews each or, without ``multi_line``, a list on each line; such files are split between tasks."""
    return spark.read.schema(schema).json(path, multiLine=multi_line)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(header=True, escape='"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_json_lists(df: DataFrame, path: str, part: Column, mode: str = "errorifexists") -> None:
    """One list of rows on a line for each value of ``part``, which keeps the lists short (a page of an answer, say)."""
    lists = df.groupBy(part.alias("__part")).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value"))
    lists.select("value").write.mode(mode).text(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each split; row counts are a query, not part of a name."""
    require_columns(df, "split").write.partitionBy("split").parquet(path)


def unseen(new: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``new`` whose key ``existing`` lacks; null keys equal each other."""
    on = None
    old = existing.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    for k in keys:
        same = new[k].eqNullSafe(old[f"__{k}"])
        on = same if on is None else on & same
    return new.join(old, on, "left_anti")


def _written(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def append_new(new: DataFrame, path: str, *keys: str) -> None:
    """Appends what the table at ``path`` doesn't have yet: a run that is repeated adds nothing."""
    spark = new.sparkSession
    if _written(spark, path):
        new = unseen(new, spark.read.parquet(path), *keys)
    new.write.mode("append").parquet(path)


def append_snapshots(new: DataFrame, path: str) -> None:
    """Appends rows (game_id, taken_at, players) to a log with a folder for each ``day``. The log keeps one snapshot of a game and day:
    the first run's, of one run's the latest (ties: most players). Rows without a time are left out. Only folders of the days in ``new`` are read."""
    spark = new.sparkSession
    dated = require_columns(new, "game_id", "taken_at", "players").withColumn("day", F.to_date("taken_at")).where("day is not null")
    once = dated.groupBy("game_id", "day").agg(F.max(F.struct("taken_at", "players")).alias("one")).select("game_id", "one.*", "day")
    first, last = dated.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return
    if _written(spark, path):
        once = unseen(once, spark.read.parquet(path).where(F.col("day").between(first, last)), "game_id", "day")
    once.write.mode("append").partitionBy("day").parquet(path)


def exclusion_list(*tables: DataFrame, key: str = "game_id") -> DataFrame:
    """Distinct non-null keys of all tables that have the column."""
    found = [t.select(key) for t in tables if key in t.columns]
    if not found:
        raise ValueError(f"no table has {key}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.dropna().distinct()


def project_raw(payload: DataFrame, author: str = "author.id") -> DataFrame:
    """Nested API rows (review, voted_up, votes_up, language, timestamp_created, and a nested ``author`` field) as raw reviews with defaults."""
    filled = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    return payload.select(
        filled("review", "").alias("review_text"), filled("voted_up", False).alias("voted_up"), filled("votes_up", 0).alias("votes_up"),
        filled("language", "").alias("language"), filled("timestamp_created", 0).alias("timestamp_created"), filled(author, "").alias("author"),
    )


def with_label(df: DataFrame) -> DataFrame:
    """One spelling of the truth: a column named sentiment or game_rating becomes label."""
    for name in ("sentiment", "game_rating"):
        if "label" not in df.columns and name in df.columns:
            df = df.withColumnRenamed(name, "label")
    return require_columns(df, "label")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def created(key: Column) -> Column:
    return F.lit(1704067200) + (key * 9973) % 2592000


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as reviews."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("text").alias("review_text"), F.col("lang").alias("language"), F.col("source").alias("game_name"),
        F.regexp_extract("source", "([0-9]+)", 1).cast("long").alias("game_id"), (F.col("doc_id") % 50).alias("votes_up"),
        created(F.col("doc_id")).alias("timestamp_created"), (F.col("doc_id") % 97).cast("string").alias("author"), "n_chars",
    )


def topical(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with the topic_id that ``embeddings`` assigns to their vector; -1, the outliers, where it has none."""
    given = table(spark, sf_dir, "embeddings").groupBy(F.col("vec_id").alias("review_id")).agg(F.min("label").alias("__topic"))
    return df.join(given, "review_id", "left").withColumn("topic_id", F.coalesce("__topic", F.lit(-1)).cast("int")).drop("__topic")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with a label, the predictions of two models and a confidence."""
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("review_id"), F.col("quality").cast("int").alias("label"), (1 - F.col("toxic")).cast("int").alias("pred_a"))
    return reviews(spark, sf_dir).join(own, "review_id").withColumns({
        "pred_b": F.when(F.col("n_chars") >= 1000, 1).otherwise(0),
        "confidence": F.lit(0.5) + (F.col("review_id") * 7919 % 500) / F.lit(1000.0),
    })
