"""Topics: assignment, class-based TF-IDF, and tables about them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators.density import OUTLIER, density_topics
from gleanery.operators.reduction import text_vectors


def text_topics(docs: DataFrame, min_topic_size: int = 10, components: int = 32, text: str = "review_text", key: str = "review_id", **dense) -> DataFrame:
    """(key, topic_id, probability) for every row of ``docs``: whole texts become vectors, vectors dense topics; -1 for outliers and for texts without a vector."""
    return density_topics(text_vectors(docs, text, key, components), min_topic_size, key=key, vector="vector", **dense)


def assign(vectors: DataFrame, k: int, min_size: int = 10, keep: float = 0.95, key: str = "vec_id", vector: str = "embedding", seed: int = 42) -> DataFrame:
    """(key, topic_id, distance): k-means clusters; rows of clusters under ``min_size`` and rows beyond the ``keep`` quantile of distance are outliers."""
    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(vector).alias("__v"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    near = model.transform(rows).withColumn("__c", F.get(centres, F.col("cluster")))
    near = near.withColumn("distance", F.sqrt(F.aggregate(F.zip_with("__v", "__c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))).select(key, "cluster", "distance")
    limits = near.groupBy("cluster").agg(F.count("*").alias("size"))
    cut = near.agg(F.percentile_approx("distance", keep, 10000).alias("cut"))
    out = F.when((F.col("size") < min_size) | (F.col("distance") > F.col("cut")), OUTLIER).otherwise(F.col("cluster"))
    return near.join(F.broadcast(limits), "cluster").crossJoin(F.broadcast(cut)).select(key, out.cast("int").alias("topic_id"), "distance")


#: Bytes of terms that a task holds before it adds them up.
_STEP = 1 << 26


def _sums(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows' terms as (topic_id, term, tf, df), one row for each topic and term. Terms and topics are numbered, so that only numbers are sorted."""
    lists = [b.column("terms") for b in held]
    terms = pa.chunked_array([x.flatten() for x in lists], pa.string()).dictionary_encode("encode")
    if not len(terms):
        return
    topics = pa.chunked_array([b.column("topic_id") for b in held]).dictionary_encode("encode")
    words, kinds = terms.chunk(0).dictionary, topics.chunk(0).dictionary
    code, topic = (np.concatenate([c.indices.to_numpy() for c in x.chunks]).astype(np.int64) for x in (terms, topics))
    row = np.repeat(np.arange(len(topic)), np.concatenate([x.value_lengths().fill_null(0).to_numpy() for x in lists]))
    own, n = np.unique(row * len(words) + code, return_counts=True)  # the distinct terms of each row
    slot, at, df = np.unique(topic[own // len(words)] * len(words) + own % len(words), return_inverse=True, return_counts=True)
    columns = [kinds.take(pa.array(slot // len(words))), words.take(pa.array(slot % len(words))), pa.array(np.bincount(at, n).astype(np.int64)), pa.array(df)]
    yield pa.RecordBatch.from_arrays(columns, names=["topic_id", "term", "tf", "df"])


def term_sums(docs: DataFrame, terms: Column, step: int = _STEP) -> DataFrame:
    """(topic_id, term, tf, df), df the rows that hold the term; docs: topic_id and what ``terms`` needs. Added up within tasks only: a pair of topic and term
    has a row for every ``step`` bytes of terms that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= step:
                yield from _sums(held)
                held, size = [], 0
        if held:
            yield from _sums(held)

    rows = docs.select("topic_id", terms.alias("terms"))
    return rows.mapInArrow(run, f"topic_id {dict(rows.dtypes)['topic_id']}, term string, tf long, df long")


def term_counts(docs: DataFrame, terms: Column, min_df: int = 2) -> DataFrame:
    """(topic_id, term, tf, f) over terms that at least ``min_df`` documents hold, f the term's words in all topics; docs: topic_id and what ``terms`` needs.
    Terms are added up in their tasks and shuffled once, by term, for the topics' sums and for those over all topics."""
    own = term_sums(docs, terms).repartition("term").groupBy("topic_id", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    every = Window.partitionBy("term")
    return own.withColumns({"f": F.sum("tf").over(every), "df": F.sum("df").over(every)}).where(F.col("df") >= min_df).select("topic_id", "term", "tf", "f")


def class_tfidf(counts: DataFrame) -> DataFrame:
    """(topic_id, term, tf, score) of ``term_counts``: term share in its topic times ln(1 + A / f), A the mean words of a topic, f the term's words in all."""
    sizes = counts.groupBy("topic_id").agg(F.sum("tf").alias("words"))
    mean = sizes.agg(F.avg("words").alias("a"))
    joined = counts.join(F.broadcast(sizes.crossJoin(F.broadcast(mean))), "topic_id")
    return joined.select("topic_id", "term", "tf", F.round(F.col("tf") / F.col("words") * F.log(1 + F.col("a") / F.col("f")), 6).alias("score"))


def topic_words(scores: DataFrame, n: int = 10) -> DataFrame:
    """(topic_id, rank, term, score): best terms of each topic, ties by term."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("score"), "term"))).where(F.col("rank") <= n).select("topic_id", "rank", "term", "score")


def topic_names(words: DataFrame, n: int = 4) -> DataFrame:
    """(topic_id, topic_name, keywords): id and first words joined, all words as a list."""
    rows = words.groupBy("topic_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("w"))
    terms = F.transform("w", lambda x: x["term"])
    return rows.select("topic_id", F.concat_ws("_", F.col("topic_id").cast("string"), F.array_join(F.slice(terms, 1, n), "_")).alias("topic_name"), F.array_join(terms, ", ").alias("keywords"))


def topic_info(docs: DataFrame, names: DataFrame) -> DataFrame:
    counts = docs.groupBy("topic_id").agg(F.count("*").alias("n"))
    return counts.join(names.select("topic_id", "topic_name"), "topic_id", "left").select("topic_id", "n", F.coalesce("topic_name", F.col("topic_id").cast("string")).alias("topic_name"))


def topic_statistics(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Reviews of each topic and their share of all, outliers included; the outlier topic has a fixed name and no keywords."""
    counts = docs.groupBy("topic_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = F.col("topic_id") == OUTLIER
    rows = counts.join(names, "topic_id", "left").crossJoin(F.broadcast(total))
    return rows.select("topic_id", F.when(out, "Outlier").otherwise(F.col("topic_name")).alias("topic_name"), F.when(out, "N/A").otherwise(F.col("keywords")).alias("keywords"), "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percentage"))


def topic_ranking(docs: DataFrame) -> DataFrame:
    """Topics by size without the outliers; ``n_topics`` counts ids other than the outlier's, whether or not there are outliers. One row a topic."""
    counts = docs.where(F.col("topic_id") != OUTLIER).groupBy("topic_id").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    return counts.withColumn("rank", F.row_number().over(every.orderBy(F.desc("n"), "topic_id"))).withColumn("n_topics", F.count("*").over(every))


def topic_samples(docs: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` reviews of each topic as one-line previews."""
    rows = docs.withColumn("rank", F.row_number().over(Window.partitionBy("topic_id").orderBy("review_id"))).where(F.col("rank") <= n)
    return rows.select("topic_id", "rank", "review_id", T.preview(F.col("review_text")).alias("preview"))


def attach_lookup(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Names and keywords by topic id; ids without an entry get null."""
    return docs.join(names, "topic_id", "left")


def text_demand(labelled: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic_id, mentions, fulfilment, probability, n, percentage): labelled reviews of each topic and their positive rate, beside all reviews of the topic,
    their mean probability and their share of all reviews. Topics without a labelled review have no mentions and a null rate."""
    every = topics.groupBy("topic_id").agg(F.count("*").alias("n"), F.round(F.avg("probability"), 9).alias("probability"))
    total = every.agg(F.sum("n").alias("total"))
    own = labelled.select("review_id", "label").join(topics.select("review_id", "topic_id"), "review_id").groupBy("topic_id").agg(F.count("*").alias("mentions"), F.round(F.avg(F.col("label").cast("double")), 9).alias("fulfilment"))
    rows = every.join(own, "topic_id", "left").crossJoin(F.broadcast(total))
    return rows.select("topic_id", F.coalesce("mentions", F.lit(0)).alias("mentions"), "fulfilment", "probability", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percentage"))
