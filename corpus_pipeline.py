"""A corpus pipeline over ``documents``: language ID, n-gram Jaccard join, substring dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
``documents``. Further columns of ``docs`` go on too where a stage carries columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import byte_bpe, chosen_path, language_id, mixing, substring_dedup
from gleanery.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = ("text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty or letterless text) go; a null lang becomes the predicted one, one that is given stays.
    Repeated rows and rows with a null doc_id are judged each for itself, very long texts whole; scores that tie go to the language first by
    name. Columns beyond ``COLUMNS``, names of results among them, are dropped; no rows give none."""
    found = language_id.identify(docs, carry=CARRIED).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links join, the one with the smallest doc_id stays (ties: smallest md5 of the text); of rows
    that repeat both, the one whose other columns are smallest. Rows with a null doc_id stay, and so do documents that only share a doc_id."""
    keyed = docs.select(*COLUMNS).withColumn("text_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    found = chosen_path.jaccard_join(keyed, carry=("text_key",)).where("doc_id = class_id").groupBy("class_node", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    # documents without a word have no class to share
    first = found.where("class_node is not null").groupBy("class_node").agg(F.min(F.struct("doc_id", "text_key", "rows")).alias("one")).select("one.*")
    keep = materialize(first.unionByName(found.where("class_node is null").drop("class_node")))
    once = keyed.join(keep.where("rows = 1"), ["doc_id", "text_key"])
    again = keyed.join(keep.where("rows > 1"), ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("one")).select("doc_id", "one.*")
    return once.select(*COLUMNS).unionByName(again.select(*COLUMNS)).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 50-word passages go; a document of which nothing is left goes whole. n_chars follows the text."""
    found = substring_dedup.remove_repeats(docs, carry=CARRIED).where("n_words = 0 or n_removed < n_words")
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities towards the target weights, rows unchanged. Null and unlisted sources and languages are one
    group, ``other``; a null or empty text weighs one token, a very long one all of its own. Draws go by doc_id: equal ones (repeated rows, null
    ones among themselves) stay or go alike, so ties don't arise. Columns beyond ``COLUMNS`` are dropped; no rows give none."""
    return mixing.mix(docs, carry=CARRIED).where("kept").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and the digests of ids and decoded bytes, a row for each row, also for repeated ones and a null doc_id. A null or
    empty text has no tokens; very long texts are encoded whole. An encoding is unique, so nothing ties. Of other columns lang and source go on, null or not; no rows give none."""
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=True, carry=("lang", "source"))


STAGES = [
    ("language_id", language),
    ("chosen_path", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: SQL expresses neither the classifier nor the draw; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
