"""Paged feeds as a Python data source, and the retry rules of their requests.

A feed is anything with ``page(key, cursor, size) -> (rows, next cursor or None)``. Cursor paging is serial, so each key
(a game) is one partition; keys are read in parallel. Options: keys, most (valid rows a key), min_length, language, review_type
(positive, negative), pause (seconds between pages). ``register(spark, feed)`` makes format ``paged_reviews``.

The same format is a stream for feeds that also have ``head(key) -> cursor`` of the place where new rows will come. The offset is a cursor for each key: a
micro-batch reads each key's pages from where the last one ended to the head, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

import re
import time
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import batched

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from gleanery.operators.sampling import ranks

LANGUAGES, KINDS = ("english", "japanese", "all"), ("positive", "negative", "all")
PAGE = 100
LOGO_ID = re.compile("/apps/([0-9]+)/")


def backoff_schedule(statuses: list[int], base: float = 1.0) -> list[float]:
    """Waits after failed attempts: base doubled each time, ten times as long after status 429."""
    return [base * 2**i * (10 if s == 429 else 1) for i, s in enumerate(statuses)]


def with_retries(call: Callable, attempts: int = 5, base: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """What ``call`` returns; the last failure is raised. A failure may carry ``status``."""
    failed: list[int] = []
    while True:
        try:
            return call()
        except OSError as e:
            failed.append(getattr(e, "status", 0))
            if len(failed) >= attempts:
                raise
            sleep(backoff_schedule(failed, base)[-1])


def validate(language: str, kind: str) -> None:
    if language not in LANGUAGES:
        raise ValueError(f"language must be one of {LANGUAGES}")
    if kind not in KINDS:
        raise ValueError(f"review_type must be one of {KINDS}")


def take_valid(feed, key: str, most: int, keep: Callable[[dict], bool], pause: float = 0.0) -> Iterator[dict]:
    """Rows of one key that ``keep`` accepts, page by page, until ``most``, an empty page or the last cursor."""
    cursor, got = "*", 0
    while got < most and cursor is not None:
        rows, cursor = with_retries(lambda c=cursor: feed.page(key, c, min(PAGE, most)))
        if not rows:
            return
        for row in rows:
            if got < most and keep(row):
                got += 1
                yield row
        if got < most and cursor is not None:
            time.sleep(pause)


def listed_games(page: Callable[[int], list[dict]], most: int = 20, pause: float = 0.5) -> list[tuple[str, str]]:
    """(app id, name) of the games on pages 1 to ``most`` of a list, up to the first empty page. Ids come from the logo's
    address; rows without one are passed over, and of rows with the same id the first counts."""
    found: dict[str, str] = {}
    for number in range(1, most + 1):
        rows = with_retries(lambda n=number: page(n))
        if not rows:
            break
        for row in rows:
            if match := LOGO_ID.search(row.get("logo") or ""):
                found.setdefault(match.group(1), row.get("name", ""))
        if number < most:
            time.sleep(pause)
    return list(found.items())


START = "*"
#: Characters that Spark writes as their code in the name of a partition's folder.
_ESCAPED = frozenset("\"#%'*/:=?\\\x7f{[]^" + "".join(map(chr, range(1, 32))))


def folder_of(key: str) -> str:
    return "game=" + "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in key)


class FolderFeed:
    """Pages written by ``write_pages``: a feed whose cursor is the number of the next page."""

    def __init__(self, path: str):
        self.path, self._known = path, ("", [])

    def _pages(self, key: str) -> list[int]:
        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(f"{root}/{folder_of(key)}", allow_not_found=True))
        return sorted(int(i.base_name.removeprefix("page=")) for i in found if i.base_name.startswith("page="))

    def head(self, key: str) -> str:
        return str(max(self._pages(key), default=-1) + 1)

    def page(self, key: str, cursor: str, size: int):
        files, root = fs.FileSystem.from_uri(self.path)
        number = 0 if cursor == START else int(cursor)
        # pages are only added, at the end: the folder is listed again when the known ones have been read
        if self._known[0] != key or not self._known[1] or self._known[1][-1] < number:
            self._known = (key, self._pages(key))
        at = bisect_left(self._known[1], number)
        if at == len(self._known[1]):
            return [], None
        page = self._known[1][at]
        rows = ds.dataset(f"{root}/{folder_of(key)}/page={page}", filesystem=files, format="parquet").to_table().sort_by("place").to_pylist()
        return rows, str(page + 1)


def write_pages(rows: DataFrame, path: str, order: list, key: str = "game", size: int = PAGE) -> None:
    """Raw reviews with a ``key`` column as pages of ``size`` rows in ``order``, numbered on from those that are there; a folder for each key and page."""
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    placed = ranks(rows.withColumnRenamed(key, "game") if key != "game" else rows, "game", order, "place", "__n").drop("__n")
    first = F.lit(0)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        # one row a key
        old = spark.read.schema("game string, page int").parquet(path).groupBy("game").agg((F.max("page") + 1).alias("__first"))
        placed, first = placed.join(old, "game", "left"), F.coalesce("__first", F.lit(0))
    paged = placed.withColumn("page", (first + F.floor((F.col("place") - 1) / size)).cast("int")).drop("__first")
    paged.repartition("game", "page").write.mode("append").partitionBy("game", "page").parquet(path)


SCHEMA = "game string, review_text string, voted_up boolean, votes_up int, language string, timestamp_created bigint, author string"
_ARROW = pa.schema([("game", pa.string()), ("review_text", pa.string()), ("voted_up", pa.bool_()), ("votes_up", pa.int32()), ("language", pa.string()), ("timestamp_created", pa.int64()), ("author", pa.string())])


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """``rows`` a page at a time: rows given one by one would be held until Spark's batch of 10,000 is full, whole texts among them."""
    for part in batched(rows, PAGE):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _ARROW)], schema=_ARROW)


def _row(key: str, r: dict) -> tuple:
    return (key, r.get("review_text") or "", bool(r.get("voted_up") or False), int(r.get("votes_up") or 0), r.get("language") or "", int(r.get("timestamp_created") or 0), r.get("author") or "")


def _keep(options: dict) -> Callable[[dict], bool]:
    shortest, language, kind = int(options.get("min_length", "0")), options.get("language", "all"), options.get("review_type", "all")
    return lambda r: len(r.get("review_text") or "") >= shortest and language in ("all", r.get("language")) and (kind == "all" or bool(r.get("voted_up")) == (kind == "positive"))


class _Reader(DataSourceReader):
    def __init__(self, feed, options: dict):
        self.feed, self.options = feed, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in self.options.get("keys", "").split(",") if k]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        found = take_valid(self.feed, partition.value, int(self.options.get("most", "100")), _keep(self.options), float(self.options.get("pause", "0.5")))
        yield from _batches(_row(partition.value, r) for r in found)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, feed, options: dict):
        self.feed, self.options = feed, options
        self.keys = [k for k in options.get("keys", "").split(",") if k]

    def initialOffset(self) -> dict:
        return {k: START for k in self.keys}

    def latestOffset(self) -> dict:
        return {k: with_retries(lambda k=k: self.feed.head(k)) for k in self.keys}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # a key that is new since the checkpoint starts at its beginning
        return [InputPartition((k, start.get(k, START), stop)) for k, stop in sorted(end.items()) if start.get(k, START) != stop]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        key, cursor, stop = partition.value
        keep, pause = _keep(self.options), float(self.options.get("pause", "0.5"))
        while cursor is not None and cursor != stop:
            rows, cursor = with_retries(lambda c=cursor: self.feed.page(key, c, PAGE))
            if not rows:
                return
            yield from (_row(key, r) for r in rows if keep(r))
            if cursor is not None and cursor != stop:
                time.sleep(pause)

    def commit(self, end: dict) -> None:
        """Nothing is held back for batches that are done."""


def register(spark: SparkSession, feed, name: str = "paged_reviews") -> None:
    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def _checked(self) -> dict:
            validate(self.options.get("language", "all"), self.options.get("review_type", "all"))
            return dict(self.options)

        def reader(self, schema) -> DataSourceReader:
            return _Reader(feed, self._checked())

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _StreamReader(feed, self._checked())

    spark.dataSource.register(Paged)
