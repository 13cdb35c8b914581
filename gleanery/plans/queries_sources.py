"""Queries: extraction from raw pages and payloads, and round trips through files and the paged source."""

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import sampling
from gleanery.plans.base import query, sql
from gleanery.sources import committed, paged
from gleanery.sources import reviews as R
from gleanery.sources.reviews import reviews, table
from gleanery.sources.scratch import new_folder
from gleanery.streaming import ingest


@query("SELECT app_id, page_id FROM (SELECT regexp_extract(url, '/([0-9]+)', 1) AS app_id, page_id FROM pages) WHERE app_id <> '' QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY page_id) = 1")
def s02_app_ids(spark, d):
    rows = table(spark, d, "pages").select(F.regexp_extract("url", "/([0-9]+)", 1).alias("app_id"), "page_id").where("app_id <> ''")
    return sampling.first_seen(rows, ["app_id"], [F.col("page_id")])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'k' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS genre FROM events")
def s06_genres_from_json(spark, d):
    """A genre list in the shape of the API's answer is built from the event's number and parsed back by path."""
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))
    payload = F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.array(F.struct(F.concat(F.lit("k"), (F.col("k") % 10).cast("string")).alias("description"))).alias("genres")).alias("data")))
    parsed = F.from_json(payload, "success boolean, data struct<genres: array<struct<description: string>>>")
    genres = F.when(parsed["success"], F.array_distinct(F.transform(parsed["data"]["genres"], lambda g: g["description"]))).otherwise(F.array().cast("array<string>"))
    return rows.select("event_id", "k", F.array_join(genres, ",").alias("genre"))


UNESCAPE = "replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '<a[^>]*>([^<]*)</a>', 1), lambda x: trim({UNESCAPE})), lambda x: x <> '')[1:6], '|') AS tags FROM pages")
def s07_page_tags(spark, d):
    """Texts of a page's anchors; these pages mark none as a tag, so anchors of any class count."""
    return table(spark, d, "pages").select("page_id", F.array_join(T.page_tags(F.col("html"), None), "|").alias("tags"))


@query("SELECT doc_id, md5(text) AS digest, n_chars FROM documents")
def s08_csv_round_trip(spark, d):
    """CSV with line breaks and quotes in texts, written and read back whole."""
    path = new_folder(spark)
    R.write_csv(table(spark, d, "documents").select("doc_id", "text", "n_chars"), path)
    return R.read_csv(spark, path, "doc_id long, text string, n_chars long").select("doc_id", F.md5("text").alias("digest"), "n_chars")


@query("SELECT doc_id, word, CASE WHEN word IN ('None', 'NA', 'nan') THEN NULL ELSE word END AS value FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'NA' WHEN 2 THEN 'nan' ELSE lang END AS word FROM documents)")
def s09_null_literals(spark, d):
    """Texts that stand for nothing stay texts by default and become null if the reader is told so."""
    path, part = new_folder(spark), F.col("doc_id") % 5
    word = F.when(part == 0, "None").when(part == 1, "NA").when(part == 2, "nan").otherwise(F.col("lang"))
    R.write_csv(table(spark, d, "documents").select("doc_id", word.alias("word")), path)
    read = lambda *literals: R.read_csv(spark, path, "doc_id long, word string", literals, multi_line=False)
    return read().join(read("None", "NA", "nan").withColumnRenamed("word", "value"), "doc_id")


@query(sql("SELECT md5(review_text) AS digest, label = 1 AS voted_up, CAST(votes_up AS INTEGER) AS votes_up, language, timestamp_created, author FROM labelled", "reviews", "labelled"))
def s10_review_lists(spark, d):
    """Lists of a hundred raw reviews each, written as JSON and read back as rows."""
    path = new_folder(spark)
    raw = R.labelled(spark, d).select("review_id", "review_text", (F.col("label") == 1).alias("voted_up"), "votes_up", "language", "timestamp_created", "author")
    R.write_json_lists(raw, path, F.floor(F.col("review_id") / 100))
    return R.read_json(spark, path, multi_line=False).withColumn("digest", F.md5("review_text")).drop("review_text")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def s17_json_round_trip(spark, d):
    path = new_folder(spark)
    R.write_json(table(spark, d, "documents").select("doc_id", "text"), path)
    return spark.read.schema("doc_id long, text string").json(path).select("doc_id", F.md5("text").alias("digest"))


@query("SELECT doc_id % 5 AS part, count(*) AS n FROM documents GROUP BY 1")
def s13_idempotent_append(spark, d):
    """Three appends of which one repeats: each key is stored once."""
    path, rows = new_folder(spark), table(spark, d, "documents").select("doc_id")
    for keep in ("doc_id % 5 < 2", "doc_id % 5 < 2", "doc_id % 5 >= 1"):
        R.append_new(rows.where(keep), path, "doc_id")
    return spark.read.parquet(path).groupBy((F.col("doc_id") % 5).alias("part")).agg(F.count("*").alias("n"))


@query("SELECT split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'val' ELSE 'test' END AS split FROM documents) GROUP BY 1")
def s12_split_files(spark, d):
    """A folder for each split, written and read back."""
    path, part = new_folder(spark), F.col("doc_id") % 20
    split = F.when(part < 14, "train").when(part < 17, "val").otherwise("test")
    R.write_splits(table(spark, d, "documents").withColumn("split", split), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT event_type AS game_id, strftime(ts, '%Y-%m-%d') AS day, value AS players FROM events WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC NULLS LAST, value DESC NULLS LAST) = 1")
def s21_snapshot_log(spark, d):
    """A dated log: each day's last event of a type as its snapshot, appended twice, of which the second adds nothing."""
    path = new_folder(spark)
    rows = table(spark, d, "events").select(F.col("event_type").alias("game_id"), F.col("ts").alias("taken_at"), F.col("value").alias("players"))
    for _ in range(2):
        R.append_snapshots(rows, path)
    return spark.read.parquet(path).select("game_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "players")


def written_pages(spark, d, order: list) -> str:
    """``documents`` as raw reviews on pages of 100, a folder for each game."""
    path = new_folder(spark)
    rows = reviews(spark, d).select(F.col("game_name").alias("game"), "review_text", (F.col("votes_up") % 2 == 0).alias("voted_up"), F.col("votes_up").cast("int").alias("votes_up"), "language", "timestamp_created", F.col("review_id").cast("string").alias("author"))
    paged.write_pages(rows, path, order)
    return path


def games_of(spark, d) -> str:
    """The games asked for; one name each."""
    return ",".join(sorted(r[0] for r in reviews(spark, d).select("game_name").distinct().collect() if r[0] is not None))


@query(sql("SELECT game_name AS game, CAST(review_id AS VARCHAR) AS author, votes_up % 2 = 0 AS voted_up, timestamp_created FROM (SELECT *, row_number() OVER (PARTITION BY game_name ORDER BY timestamp_created DESC, review_id) AS r FROM reviews WHERE length(review_text) >= 20 AND votes_up % 2 = 0) WHERE r <= 100", "reviews"))
def s03_paged_reviews(spark, d):
    """The latest hundred valid positive reviews of each game, page by page from a cursor feed of the whole table."""
    paged.register(spark, paged.FolderFeed(written_pages(spark, d, [F.desc("timestamp_created"), F.col("author").cast("long")])), "paged_table")
    rows = spark.read.format("paged_table").options(keys=games_of(spark, d), most="100", min_length="20", review_type="positive", pause="0").load()
    return rows.select("game", "author", "voted_up", "timestamp_created")


@query(sql("SELECT game_name AS game, count(*) AS n, CAST(sum(review_id) AS BIGINT) AS ids, min(timestamp_created) AS first, max(timestamp_created) AS last FROM reviews WHERE length(review_text) >= 1 GROUP BY 1", "reviews"))
def s03_paged_stream(spark, d):
    """Every review through the cursor stream into a table of whole batches."""
    paged.register(spark, paged.FolderFeed(written_pages(spark, d, [F.col("timestamp_created"), F.col("author").cast("long")])), "paged_stream")
    rows = spark.readStream.format("paged_stream").options(keys=games_of(spark, d), min_length="1", pause="0").load().withColumn("ts", F.timestamp_seconds("timestamp_created"))
    path, late, checkpoint = new_folder(spark), new_folder(spark), new_folder(spark)
    ingest.start_ingest(rows, path, late, checkpoint, ["game", "author"]).awaitTermination()
    return committed.read(spark, path).groupBy("game").agg(F.count("*").alias("n"), F.sum(F.col("author").cast("long")).alias("ids"), F.min("timestamp_created").alias("first"), F.max("timestamp_created").alias("last"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT event_type) AS n_types, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE ts IS NOT NULL GROUP BY 1")
def s15_committed_batches(spark, d):
    """Events written as two overlapping batches, each twice: the table has every event once, in files by day."""
    path = new_folder(spark)
    rows = table(spark, d, "events").withColumn("day", F.col("ts").cast("date")).where("day is not null")
    for label, part in (("0", rows.where("event_id % 3 <> 0")), ("1", rows), ("1", rows)):
        committed.write_new(part, path, label, ["event_id"], "day")
    return committed.read(spark, path).groupBy("day").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("n_types"), F.sum("event_id").alias("ids"))


@query(sql("SELECT game_name AS game, count(*) AS n, CAST(sum(review_id) AS BIGINT) AS ids FROM reviews WHERE length(review_text) >= 10 GROUP BY 1", "reviews"))
def s03_paged_source(spark, d):
    """All reviews of ten characters or more of each game through the paged source, as no game has more than its rows."""
    rows = reviews(spark, d)
    paged.register(spark, paged.FolderFeed(written_pages(spark, d, [F.col("author").cast("long")])), "paged_all")
    found = spark.read.format("paged_all").options(keys=games_of(spark, d), most=str(rows.count()), min_length="10", pause="0").load()
    return found.groupBy("game").agg(F.count("*").alias("n"), F.sum(F.col("author").cast("long")).alias("ids"))
