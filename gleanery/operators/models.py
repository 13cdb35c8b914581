"""Sentiment models on Spark ML: fit, score, calibrate, save; anything with ``transform`` can take the default's place."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECOMMENDED = {"english": "count-logistic", "japanese": "char-logistic"}
PROBES = ("This is great, I love it", "This is terrible, I hate it")


def recommended_model(language: str) -> str:
    try:
        return RECOMMENDED[language.lower()]
    except KeyError:
        raise ValueError(f"no model for {language}") from None


def parse_model_spec(spec: str) -> tuple[str, str, str]:
    """kind:path[:label]; the label defaults to the path's last part."""
    kind, _, rest = spec.partition(":")
    if kind not in ("self", "hf") or not rest:
        raise ValueError("expected self:path[:label] or hf:path[:label]")
    path, _, label = rest.partition(":")
    return kind, path, label or path.rstrip("/").rsplit("/", 1)[-1]


def fit(train: DataFrame, text: str = "review_text", vocabulary: int = 1 << 16, max_iter: int = 30) -> PipelineModel:
    """Token counts and logistic regression; the vocabulary's size is a parameter. The counts learned without labels are what domain adaptation shares between models."""
    words = RegexTokenizer(inputCol=text, outputCol="words", pattern="[^a-z']+", minTokenLength=1)
    counts = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary, minDF=2)
    return Pipeline(stages=[words, counts, LogisticRegression(maxIter=max_iter, regParam=0.01)]).fit(train)


def adapted_fit(corpus: DataFrame, train: DataFrame, text: str = "review_text", vocabulary: int = 1 << 16) -> PipelineModel:
    """The vocabulary comes from an unlabelled corpus, the weights from labelled rows."""
    words = RegexTokenizer(inputCol=text, outputCol="words", pattern="[^a-z']+", minTokenLength=1)
    counts = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary, minDF=2).fit(words.transform(corpus))
    base = Pipeline(stages=[words, counts]).fit(corpus)
    top = LogisticRegression(maxIter=30, regParam=0.01).fit(base.transform(train))
    return PipelineModel(stages=[words, counts, top])


def score(df: DataFrame, model: Transformer, key: str = "review_id") -> DataFrame:
    """(key, prediction 0/1, sentiment, score: probability of the prediction)."""
    p = vector_to_array("probability")
    out = model.transform(df).select(key, F.col("prediction").cast("int").alias("prediction"), F.array_max(p).alias("score"))
    return out.withColumn("sentiment", F.when(F.col("prediction") == 1, "POSITIVE").otherwise("NEGATIVE"))


def label_of(sentiment: str = "sentiment"):
    return F.when(F.upper(F.col(sentiment)) == "POSITIVE", 1).otherwise(0)


def calibrate(model: Transformer, spark, text: str = "review_text") -> bool:
    """Whether label 1 is the positive one, from two probe sentences; an error if the model can't tell them apart."""
    rows = spark.createDataFrame([(0, PROBES[0]), (1, PROBES[1])], f"review_id int, {text} string")
    said = {r.review_id: r.prediction for r in score(rows, model).collect()}
    if said[0] == said[1]:
        raise ValueError("the model gives both probe sentences one label")
    return said[0] == 1


def token_coefficients(model: PipelineModel) -> DataFrame:
    """(token, coefficient) of a fitted default model; as many rows as its vocabulary."""
    from pyspark.sql import SparkSession

    counts, top = model.stages[-2], model.stages[-1]
    return SparkSession.active().createDataFrame([(w, float(c)) for w, c in zip(counts.vocabulary, top.coefficients.toArray())], "token string, coefficient double")
