"""Experiment tables: runs by seed and size, paired tests, learning curves, early stopping, grids with resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.stats import student_p, t_test_p, wilcoxon_p
from gleanery.sources.reviews import unseen


def group_stats(df: DataFrame, by: list[str], values: list[str], digits: int = 2) -> DataFrame:
    """Mean, sample deviation and count of each value, rounded half to even as in data frames."""
    cols = [f for v in values for f in (F.bround(F.avg(v), digits).alias(f"{v}_mean"), F.bround(F.stddev_samp(v), digits).alias(f"{v}_std"))]
    return df.groupBy(*by).agg(*cols, F.count("*").alias("n"))


def run_stats(df: DataFrame, value: str = "ood_acc", by: str = "base") -> DataFrame:
    """Mean, deviation (0.0 for one run), smallest and largest of successful runs."""
    good = df.where(F.coalesce("error", F.lit("")) == "") if "error" in df.columns else df
    return good.groupBy(by).agg(F.round(F.avg(value), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 9).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"))


def paired(df: DataFrame, key: str = "seed", by: str = "base", a: str = "a", b: str = "b", value: str = "ood_acc") -> DataFrame:
    """(key, a, b, diff): the mean of each base, keys that lack one left out."""
    return df.groupBy(key).pivot(by, [a, b]).agg(F.avg(value)).dropna().withColumn("diff", F.col(b) - F.col(a))


def paired_stats(pairs: DataFrame) -> DataFrame:
    """Mean and deviation of differences, wins, and the paired t statistic."""
    d = pairs.agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("std_diff"), F.count_if(F.col("diff") > 0).alias("wins"))
    return d.withColumn("t", F.col("mean_diff") / F.nullif(F.col("std_diff") / F.sqrt("n"), F.lit(0.0)))


def paired_t(df: DataFrame, by: list[str], diff: str = "diff") -> DataFrame:
    """(by, n, t, p): the paired t test of each group in one grouped pass; t and p are null for one pair or equal differences."""
    d = df.groupBy(*by).agg(F.count(diff).alias("n"), F.avg(diff).alias("__m"), F.stddev_samp(diff).alias("__s"))
    t = F.col("__m") / F.nullif(F.col("__s") / F.sqrt("n"), F.lit(0.0))
    return d.withColumn("t", t).select(*by, "n", "t", student_p(F.col("t"), F.col("n")).alias("p"))


def signed_ranks(pairs: DataFrame) -> DataFrame:
    """n, w_plus, w_minus, w and whether absolute differences tie; zero differences are left out and ties share their mean rank. One row for each pair of runs, a small table."""
    rows = pairs.where(F.round("diff", 9) != 0).withColumn("size", F.round(F.abs("diff"), 9))
    every = Window.partitionBy(F.lit(0)).orderBy("size")
    own = Window.partitionBy("size")
    rows = rows.withColumn("r", F.rank().over(every)).withColumn("c", F.count("*").over(own)).withColumn("rank", F.col("r") + (F.col("c") - 1) / 2)
    side = lambda up: F.coalesce(F.sum(F.when((F.col("diff") > 0) == up, F.col("rank"))), F.lit(0.0))
    out = rows.agg(F.count("*").alias("n"), side(True).alias("w_plus"), side(False).alias("w_minus"), F.coalesce(F.max("c") > 1, F.lit(False)).alias("ties"))
    return out.withColumn("w", F.least("w_plus", "w_minus"))


def paired_tests(pairs: DataFrame) -> DataFrame:
    """One row: t, p of t, w, p of w. The statistics are aggregates; only they come to the driver for the p-values."""
    t, w = paired_stats(pairs).first(), signed_ranks(pairs).first()
    row = (t.n, t.t, t_test_p(t.t, t.n), w.w if w.n else None, wilcoxon_p(w.w, w.n, w.ties) if w.n else None)
    return pairs.sparkSession.createDataFrame([row], "n long, t double, t_p double, w double, w_p double")


def representative(df: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """The run at the upper median of ``score`` in each group."""
    w = Window.partitionBy(*by)
    return df.withColumn("__r", F.row_number().over(w.orderBy(score, tie))).withColumn("__n", F.count("*").over(w)).where(F.col("__r") == F.floor(F.col("__n") / 2) + 1).drop("__r", "__n")


def success_rates(df: DataFrame, by: str = "data_size", value: str = "test_acc", target: float = 85.0) -> DataFrame:
    c = df.groupBy(by).agg(F.count_if(F.col(value) >= target).alias("n_success"), F.count("*").alias("n"))
    return c.withColumn("rate", F.round(F.col("n_success") / F.col("n"), 6))


def optimal_size(df: DataFrame, by: str = "data_size", value: str = "test_acc", target: float = 85.0) -> DataFrame:
    """The smallest size whose trials all reach the target, else the smallest whose mean does, else null."""
    sizes = df.groupBy(by).agg(F.min(value).alias("worst"), F.avg(value).alias("mean"))
    first = lambda c: F.min(F.when(F.col(c) >= target, F.col(by)))
    return sizes.agg(F.coalesce(first("worst"), first("mean")).alias("optimal_size"), F.when(first("worst").isNotNull(), "all").when(first("mean").isNotNull(), "mean").otherwise("none").alias("rule"))


def long_metrics(df: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    return df.unpivot(keep, names, "metric", "value")


def early_stopping(history: DataFrame, run: str = "run", patience: int = 3) -> DataFrame:
    """(run, best_epoch, stop_epoch) from (run, epoch, val_acc): training stops once ``patience`` epochs in a row bring no strict gain."""
    w = Window.partitionBy(run).orderBy("epoch")
    best = F.max("val_acc").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("gain", F.coalesce(F.col("val_acc") > best, F.lit(True)))
    rows = rows.withColumn("last_gain", F.max(F.when(F.col("gain"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("stop", F.col("epoch") - F.col("last_gain") >= patience)
    stops = rows.groupBy(run).agg(F.coalesce(F.min(F.when(F.col("stop"), F.col("epoch"))), F.max("epoch")).alias("stop_epoch"))
    seen = rows.join(stops, run).where("epoch <= stop_epoch")
    return seen.groupBy(run, "stop_epoch").agg(F.max(F.when(F.col("gain"), F.col("epoch"))).alias("best_epoch"))


def grid(seeds: DataFrame, bases: DataFrame) -> DataFrame:
    """Every seed with every base: two short parameter lists, not data."""
    return seeds.crossJoin(bases)


def pending(wanted: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return unseen(wanted, done, *keys)
