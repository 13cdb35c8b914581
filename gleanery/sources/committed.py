"""Tables that grow by whole batches: a Python data source writer with commit and abort.

Tasks write Parquet files; one manifest, moved into place when all tasks are done, makes a batch's files part of the table. A task that fails
leaves files that no manifest names, so readers never see a part of a batch. A batch written again under the same label changes
nothing. Files are of one day (or other value) each, so that a reader may ask for some days alone. The folder is on the file system that the driver and all executors share; moving a file must be atomic there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "committed_batches"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _delete(files: fs.FileSystem, names: list[str]) -> None:
    for name in names:
        if files.get_file_info(name).type != fs.FileType.NotFound:
            files.delete_file(name)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: name, value of the dividing column, rows, latest time in microseconds."""

    files: list[dict] = field(default_factory=list)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict):
        self.path, self.label, self.by, self.time = options["path"], options["label"], options.get("by", ""), options.get("time", "")
        self.schema = schema.json()

    def _runs(self, iterator: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, pa.RecordBatch]]:
        """Slices whose rows share the dividing value; rows come sorted by it."""
        for batch in iterator:
            if not self.by:
                yield None, batch
                continue
            values, at = [None if v is None else str(v) for v in batch.column(self.by).to_pylist()], 0
            for stop in range(1, batch.num_rows + 1):
                if stop == batch.num_rows or values[stop] != values[at]:
                    yield values[at], batch.slice(at, stop - at)
                    at = stop

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _open(self.path)
        files.create_dir(f"{root}/data", recursive=True)
        done, now, writer = Written(), None, None
        try:
            for value, batch in self._runs(iterator):
                if not batch.num_rows:
                    continue
                if writer is None or value != now["value"]:
                    if writer is not None:
                        writer.close()
                    now = {"name": f"data/{self.label}-{uuid.uuid4().hex}.parquet", "value": value, "rows": 0, "latest": None}
                    done.files.append(now)
                    writer = pq.ParquetWriter(f"{root}/{now['name']}", batch.schema, filesystem=files)
                writer.write_batch(batch)
                now["rows"] += batch.num_rows
                if self.time:
                    times = [t for t in batch.column(self.time).cast(pa.int64()).to_pylist() if t is not None]
                    now["latest"] = max([*times, *([] if now["latest"] is None else [now["latest"]])], default=None)
            if writer is not None:
                writer.close()
        except BaseException:
            if writer is not None:
                writer.close()
            _delete(files, [f"{root}/{f['name']}" for f in done.files])
            raise
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _open(self.path)
        found = [f for m in messages if m is not None for f in m.files]
        final = f"{root}/_commits/{self.label}.json"
        if files.get_file_info(final).type != fs.FileType.NotFound:
            _delete(files, [f"{root}/{f['name']}" for f in found])
            return
        files.create_dir(f"{root}/_commits", recursive=True)
        draft = f"{root}/_commits/.{self.label}-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps({"label": self.label, "schema": self.schema, "files": found}).encode())
        files.move(draft, final)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _open(self.path)
        _delete(files, [f"{root}/{f['name']}" for m in messages if m is not None for f in m.files])


class CommittedBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(schema, dict(self.options))


def write(df: DataFrame, path: str, label: str, by: str = "", time: str = "") -> None:
    """Adds ``df`` to the table at ``path`` as batch ``label``, whole or not at all. ``by`` divides its files, ``time`` is the timestamp whose latest value is kept."""
    df.sparkSession.dataSource.register(CommittedBatches)
    rows = df.sortWithinPartitions(by) if by else df
    rows.write.format(FORMAT).mode("append").options(path=path, label=label, by=by, time=time).save()


def manifests(path: str) -> list[dict]:
    """What has been committed, by label. A few hundred bytes a file; no rows are read."""
    files, root = _open(path)
    if files.get_file_info(f"{root}/_commits").type == fs.FileType.NotFound:
        return []
    names = [i.path for i in files.get_file_info(fs.FileSelector(f"{root}/_commits")) if i.base_name.endswith(".json") and not i.base_name.startswith(".")]
    out = []
    for name in sorted(names):
        with files.open_input_stream(name) as f:
            out.append(json.loads(f.read()))
    return out


def has(path: str, label: str) -> bool:
    files, root = _open(path)
    return files.get_file_info(f"{root}/_commits/{label}.json").type != fs.FileType.NotFound


def latest(path: str, before: str) -> int | None:
    """The latest time, in microseconds, of all batches whose label sorts before ``before``."""
    found = [f["latest"] for m in manifests(path) if m["label"] < before for f in m["files"] if f["latest"] is not None]
    return max(found, default=None)


def read(spark: SparkSession, path: str, values: list[str] | None = None) -> DataFrame | None:
    """The table's committed rows, or those of the files whose dividing value is in ``values`` (None: all); None if nothing has been committed. Other files aren't opened."""
    known = manifests(path)
    if not known:
        return None
    names = [f"{path.rstrip('/')}/{f['name']}" for m in known for f in m["files"] if values is None or f["value"] in values]
    schema = StructType.fromJson(json.loads(known[0]["schema"]))
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def write_new(df: DataFrame, path: str, label: str, keys: list[str], by: str, time: str = "") -> None:
    """Like ``write`` for the rows whose ``keys`` the table lacks, each once; of the table only files with the ``by`` values of ``df`` are read, as equal keys share it."""
    if has(path, label):
        return
    touched = [None if r[0] is None else str(r[0]) for r in df.select(by).distinct().collect()]
    once, old = df.dropDuplicates(keys), read(df.sparkSession, path, touched)
    if old is not None:
        on = None
        seen = old.select(*[F.col(k).alias(f"__{k}") for k in keys])
        for k in keys:
            same = once[k].eqNullSafe(seen[f"__{k}"])
            on = same if on is None else on & same
        once = once.join(seen, on, "left_anti")
    write(once, path, label, by, time)
