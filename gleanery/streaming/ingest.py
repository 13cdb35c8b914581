"""Incremental ingestion: event-time windows, late rows, duplicates, and idempotent batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.sources import committed
from gleanery.sources.reviews import append_new


def read_events(spark: SparkSession, folder: str, names: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder, whose names match, as a stream; ``ts`` becomes a timestamp with zone, as watermarks need."""
    schema = spark.read.option("pathGlobFilter", names).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", names).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 day", key: str = "event_id", by: str = "event_type") -> DataFrame:
    """(start, type, n, total) by tumbling window; rows later than the watermark are dropped, repeated keys within it count once. Works on streams and on tables."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
    counts = once.groupBy(F.window("ts", window).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("start"), by, "n", "total")


def start_upserts(rows: DataFrame, path: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Appends each micro-batch's new keys to the table at ``path``; a batch that runs again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch.dropDuplicates(list(keys)), path, *keys)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_of(batch: int) -> str:
    """Labels sort like their numbers."""
    return f"{batch:012d}"


def start_ingest(rows: DataFrame, path: str, late_path: str, checkpoint: str, keys: list[str], time: str = "ts", delay_seconds: int = 86_400) -> StreamingQuery:
    """Grows the table at ``path`` by the new keys of each micro-batch, a batch whole or not at all; what comes too late goes to ``late_path`` instead of getting lost.

    A row is late if its time lies more than ``delay_seconds`` before the latest time of all earlier batches, or is null. That bound comes from what was
    committed before, so a batch that runs again, after a stop in any place, is divided in the same way and adds nothing twice. Equal keys have equal times; a column
    ``day`` is added, and only the table's files of the days in a batch are read."""

    def write(batch: DataFrame, number: int) -> None:
        label = label_of(number)
        dated = batch.withColumn("day", F.to_date(time)).persist()
        try:
            mark = committed.latest(path, label)
            bound = F.timestamp_micros(F.lit(0 if mark is None else mark - delay_seconds * 1_000_000))
            fresh = F.col(time).isNotNull() & (F.lit(mark is None) | (F.col(time) >= bound))
            committed.write_new(dated.where(~fresh), late_path, label, keys, "day", time)
            committed.write_new(dated.where(fresh), path, label, keys, "day", time)
        finally:
            dated.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, name: str, mode: str, checkpoint: str, then: Callable[[StreamingQuery], None] | None = None) -> DataFrame:
    """Runs all that is there into an in-memory table; for results as small as windows are."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if then:
        then(query)
    return df.sparkSession.table(name)
