"""Cursor offsets, whole batches, late rows: what a stop in the middle leaves."""

import datetime
import glob

import pytest
from pyspark.sql import functions as F

from gleanery.sources import committed, paged
from gleanery.streaming import ingest

T0 = datetime.datetime(2024, 1, 1)


def test_a_failing_task_leaves_no_row(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(100, numPartitions=4).select("id", (F.col("id") % 3).alias("day"), F.timestamp_seconds(F.col("id")).alias("ts"))
    bad = F.udf(lambda i: 1 // (i - 77), "long")
    with pytest.raises(Exception):
        committed.write(rows.withColumn("id", F.col("id") + 0 * bad("id")), path, "a", "day", "ts")
    assert committed.read(spark, path) is None and not committed.has(path, "a") and glob.glob(f"{tmp_path}/t/_commits/*") == []
    for _ in range(2):  # a label counts once
        committed.write(rows, path, "a", "day", "ts")
    assert committed.read(spark, path).count() == 100 and committed.has(path, "a")
    assert sorted(r.id for r in committed.read(spark, path, ["1"]).collect()) == list(range(1, 100, 3))
    assert committed.latest(path, "b") == 99_000_000 and committed.latest(path, "a") is None
    named = {f["name"] for m in committed.manifests(path) for f in m["files"]}
    assert sum(f["rows"] for m in committed.manifests(path) for f in m["files"]) == 100 and all(glob.glob(f"{tmp_path}/t/{n}") for n in named)
    committed.write(rows.where("false"), path, "empty", "day", "ts")
    assert committed.has(path, "empty") and committed.read(spark, path, ["nothing"]).count() == 0


def test_new_keys_read_only_their_days(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    make = lambda data: spark.createDataFrame(data, "id long, day string")
    committed.write_new(make([(1, "x"), (1, "x"), (None, None), (2, "y")]), path, "0", ["id"], "day")
    for f in glob.glob(f"{tmp_path}/t/data/*"):
        if any(n["name"] in f and n["value"] == "y" for m in committed.manifests(path) for n in m["files"]):
            open(f, "w").write("not parquet")  # a day that isn't touched isn't opened
    committed.write_new(make([(1, "x"), (3, "x"), (None, None)]), path, "1", ["id"], "day")
    assert sorted(r.id for r in committed.read(spark, path, ["x"]).collect()) == [1, 3]
    assert committed.read(spark, path, [None]).count() == 1


def reviews(spark, low, high, games=("a b", "g/2")):
    data = [(g, f"review number {i} of {g}", i % 2 == 0, i, "english", i, str(i)) for g in games for i in range(low, high)]
    return spark.createDataFrame(data, "game string, review_text string, voted_up boolean, votes_up int, language string, timestamp_created long, author string")


def test_cursor_stream_goes_on_where_it_stopped(spark, tmp_path):
    path, out, late, cp = (f"file://{tmp_path}/{n}" for n in ("pages", "out", "late", "cp"))
    order = [F.col("timestamp_created")]
    paged.write_pages(reviews(spark, 0, 25), path, order, size=10)
    feed = paged.FolderFeed(path)
    assert feed.head("a b") == "3" and feed.head("none") == "0" and [len(feed.page("g/2", c, 10)[0]) for c in ("*", "1", "2", "3")] == [10, 10, 5, 0]
    paged.register(spark, feed, "paged_test")
    keys = ["game", "author"]

    def run(failing=False):
        rows = spark.readStream.format("paged_test").options(keys="a b,g/2", pause="0", min_length="5").load().withColumn("ts", F.timestamp_seconds("timestamp_created"))
        if failing:
            rows = rows.withColumn("votes_up", F.udf(lambda v: v if v != 31 else 1 // 0, "int")("votes_up"))
        ingest.start_ingest(rows, out, late, cp, keys).awaitTermination()

    run()
    assert committed.read(spark, out).count() == 50
    paged.write_pages(reviews(spark, 25, 40), path, order, size=10)
    with pytest.raises(Exception):
        run(failing=True)  # stopped within the second batch
    assert committed.read(spark, out).count() == 50
    run()  # the same batch again, whole
    got = sorted((r.game, r.votes_up) for r in committed.read(spark, out).collect())
    assert got == sorted((g, i) for g in ("a b", "g/2") for i in range(40))
    run()  # nothing new
    assert committed.read(spark, out).count() == 80 and [m["label"] for m in committed.manifests(out)] == [ingest.label_of(0), ingest.label_of(1)]
    assert len({r.game for r in spark.read.format("paged_test").options(keys="a b,g/2", pause="0", most="30").load().collect()}) == 2


def test_late_rows_are_kept_aside(spark, tmp_path):
    src = tmp_path / "src"
    day = lambda k: T0 + datetime.timedelta(days=k)
    batches = [[(1, day(0)), (2, day(5)), (2, day(5))], [(3, day(4)), (4, day(1)), (2, day(5)), (5, None)], [(6, day(9)), (7, day(3)), (1, day(0))]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "event_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/w{i}")
        src.mkdir(exist_ok=True)
        for f in glob.glob(f"{tmp_path}/w{i}/*.parquet"):
            (src / f"{i}.parquet").write_bytes(open(f, "rb").read())
        ingest.start_ingest(ingest.read_events(spark, str(src), files_per_trigger=10), f"file://{tmp_path}/out", f"file://{tmp_path}/late", f"{tmp_path}/cp", ["event_id"], delay_seconds=2 * 86_400).awaitTermination()
    ids = lambda p: sorted(r.event_id for r in committed.read(spark, f"file://{tmp_path}/{p}").collect())
    assert ids("out") == [1, 2, 3, 6, 7] and ids("late") == [1, 4, 5]
