"""Classifier metrics from one pass of counts, comparisons of models, and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.stats import mcnemar_p, ratio


def confusion(truth: str = "label", pred: str = "pred_a") -> list[Column]:
    y, p = F.col(truth), F.col(pred)
    pairs = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return [F.count_if((y == a) & (p == b)).alias(n) for n, (a, b) in pairs.items()]


def check_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no rows to evaluate")
    return df


def metrics(df: DataFrame, truth: str = "label", pred: str = "pred_a", by: list[str] | None = None) -> DataFrame:
    """Counts, accuracy, precision, recall and F1, 0.0 where undefined; always four counts, even if one class is absent."""
    c = df.groupBy(*(by or [])).agg(*confusion(truth, pred))
    out = c.withColumns({
        "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
    })
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def per_class(df: DataFrame, truth: str = "label", pred: str = "pred_a") -> DataFrame:
    """(class, correct, total, accuracy) for positive and negative; 0.0 for an absent class."""
    c = df.agg(*confusion(truth, pred))
    rows = c.select(F.inline(F.array(F.struct(F.lit("positive").alias("class"), F.col("tp").alias("correct"), (F.col("tp") + F.col("fn")).alias("total")), F.struct(F.lit("negative").alias("class"), F.col("tn").alias("correct"), (F.col("tn") + F.col("fp")).alias("total")))))
    return rows.withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def report(df: DataFrame, truth: str = "label", pred: str = "pred_a") -> DataFrame:
    """Precision, recall, F1 and support of each class, and their plain and weighted means."""
    c = df.agg(*confusion(truth, pred))
    rows = c.select(F.inline(F.array(
        F.struct(F.lit("negative").alias("class"), F.col("tn").alias("hit"), (F.col("tn") + F.col("fn")).alias("said"), (F.col("tn") + F.col("fp")).alias("support")),
        F.struct(F.lit("positive").alias("class"), F.col("tp").alias("hit"), (F.col("tp") + F.col("fp")).alias("said"), (F.col("tp") + F.col("fn")).alias("support")),
    )))
    rows = rows.withColumn("precision", ratio(F.col("hit"), F.col("said"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    rows = rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "precision", "recall", "f1", "support")
    names = ["precision", "recall", "f1"]
    macro = rows.agg(F.lit("macro avg").alias("class"), *[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("class"), *[ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")).alias(n) for n in names], F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted)


def error_summary(df: DataFrame, truth: str = "label", pred: str = "pred_a", sure: float = 0.9) -> DataFrame:
    wrong = F.col(truth) != F.col(pred)
    return df.where(wrong).agg(F.count("*").alias("n_errors"), F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.count_if(F.col("confidence") >= sure).alias("high_confidence"))


def mcnemar(df: DataFrame, a: str, b: str, truth: str = "label") -> DataFrame:
    """only_a, only_b (rows that just one model gets right), discordant, exact p, significant."""
    y = F.col(truth)
    c = df.agg(F.count_if((F.col(a) == y) & (F.col(b) != y)).alias("only_a"), F.count_if((F.col(a) != y) & (F.col(b) == y)).alias("only_b"))
    c = c.withColumn("discordant", F.col("only_a") + F.col("only_b")).withColumn("p_value", mcnemar_p(F.col("only_a"), F.col("only_b")))
    return c.withColumn("significant", F.col("p_value") < 0.05)


def compare_all(df: DataFrame, models: list[str], truth: str = "label") -> DataFrame:
    """``mcnemar`` of each pair of prediction columns; one pass over the rows for all pairs."""
    y = F.col(truth)
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    counts = df.agg(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.count_if((F.col(a) == y) & (F.col(b) != y)).alias("only_a"), F.count_if((F.col(a) != y) & (F.col(b) == y)).alias("only_b")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = counts.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])))
    return rows.withColumn("discordant", F.col("only_a") + F.col("only_b")).withColumn("p_value", mcnemar_p(F.col("only_a"), F.col("only_b"))).withColumn("significant", F.col("p_value") < 0.05)


def deltas(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """(metric, a, b, delta) of two one-row metric frames."""
    long = lambda df, v: df.select(F.expr(f"stack({len(names)}, {', '.join(f'{n!r}, {n}' for n in names)}) as (metric, {v})"))
    return long(a, "a").join(long(b, "b"), "metric").withColumn("delta", F.col("a") - F.col("b"))


#: Lower bounds of grades by language: fixed values.
GRADES = {"english": [(0.90, "excellent"), (0.85, "good"), (0.80, "acceptable")], "japanese": [(0.85, "excellent"), (0.80, "acceptable")]}


def grade(accuracy: Column, language: str) -> Column:
    if language not in GRADES:
        raise ValueError(f"language must be one of {sorted(GRADES)}")
    out = F.when(F.lit(False), F.lit(""))
    for least, name in GRADES[language]:
        out = out.when(accuracy >= least, name)
    return out.otherwise("poor")


def recommendation(english: Column, japanese: Column) -> Column:
    return F.when((english >= 0.90) & (japanese >= 0.85), "either").when(english >= 0.90, "english").when(english < 0.85, "investigate").otherwise("review")


def validation_verdict(accuracy: Column) -> Column:
    return F.when(accuracy >= 0.90, "pass").when(accuracy >= 0.85, "tolerable").otherwise("fail")


def label_shares(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select(label, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def split_statistics(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    c = df.groupBy(split).agg(F.count("*").alias("total"), F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative"))
    return c.withColumns({"positive_share": F.round(F.col("positive") / F.col("total"), 6), "negative_share": F.round(F.col("negative") / F.col("total"), 6)})
