"""Tables between steps: written to the folder that the driver and all executors share, removed when the application ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a folder of its own and any other is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gleanery-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """The path of a folder that isn't there yet; what is written to it goes when the application ends."""
    path = f"{shared_dir(spark)}/gleanery-{uuid.uuid4().hex}"
    context = spark.sparkContext
    own = context._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(own)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` and reads it back: later steps neither recompute it nor depend on the executors that made it."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
