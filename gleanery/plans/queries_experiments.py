"""Queries: seeds, learning curves, early stopping, resumable grids."""

from pyspark.sql import functions as F

from gleanery.operators import experiments as X
from gleanery.plans.base import query, sql
from gleanery.sources.reviews import labelled

RUNS = ("reviews", "labelled", "runs")
CURVE = ("reviews", "labelled", "curve")


def accuracy(pred: str):
    return F.round(100.0 * F.sum(F.when(F.col("label") == F.col(pred), 1).otherwise(0)) / F.count("*"), 6)


def runs(spark, d):
    df = labelled(spark, d)
    one = lambda base, pred: df.groupBy(F.col("game_id").alias("seed")).agg(accuracy(pred).alias("ood_acc")).withColumn("base", F.lit(base))
    return one("a", "pred_a").unionByName(one("b", "pred_b")).select("seed", "base", "ood_acc")


def curve(spark, d):
    size = F.when(F.col("n_chars") < 500, 500).when(F.col("n_chars") < 2000, 2000).otherwise(20000)
    return labelled(spark, d).groupBy(size.alias("data_size"), (F.col("review_id") % 3).alias("trial")).agg(accuracy("pred_a").alias("test_acc"), accuracy("pred_b").alias("val_acc"))


def long_history(spark, d):
    """A stand-in history: the b accuracy of each seed in four base points by epoch."""
    return runs(spark, d).where("base = 'b'").select(F.col("seed").alias("run"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("epoch")).withColumn("val_acc", (F.pmod(F.col("run") * 31 + F.col("epoch") * F.col("epoch") * 17, F.lit(23))).cast("double"))


@query(sql("SELECT data_size, round_even(avg(test_acc), 2) AS test_acc_mean, round_even(stddev_samp(test_acc), 2) AS test_acc_std, round_even(avg(val_acc), 2) AS val_acc_mean, round_even(stddev_samp(val_acc), 2) AS val_acc_std, count(*) AS n FROM curve GROUP BY data_size", *CURVE))
def a07_curve_stats(spark, d):
    return X.group_stats(curve(spark, d), ["data_size"], ["test_acc", "val_acc"])


@query(sql("SELECT base, round(avg(ood_acc), 9) AS mean, round(coalesce(stddev_samp(ood_acc), 0.0), 9) AS std, min(ood_acc) AS min, max(ood_acc) AS max, count(*) AS n FROM runs GROUP BY base", *RUNS))
def a08_run_stats(spark, d):
    return X.run_stats(runs(spark, d))


@query(sql("SELECT data_size, count(*) FILTER (WHERE test_acc >= 85) AS n_success, count(*) AS n, round(count(*) FILTER (WHERE test_acc >= 85) / count(*), 6) AS rate FROM curve GROUP BY data_size", *CURVE))
def a20_success_rates(spark, d):
    return X.success_rates(curve(spark, d))


@query(sql("""SELECT coalesce(w, m) AS optimal_size, CASE WHEN w IS NOT NULL THEN 'all' WHEN m IS NOT NULL THEN 'mean' ELSE 'none' END AS rule FROM (SELECT min(CASE WHEN worst >= 85 THEN data_size END) AS w, min(CASE WHEN mean >= 85 THEN data_size END) AS m
    FROM (SELECT data_size, min(test_acc) AS worst, avg(test_acc) AS mean FROM curve GROUP BY 1))""", *CURVE))
def a21_optimal_size(spark, d):
    return X.optimal_size(curve(spark, d), target=85.0)


@query(sql("SELECT epoch, round(avg(CAST((run * 31 + epoch * epoch * 17) % 23 AS DOUBLE)), 9) AS mean_val_acc FROM (SELECT DISTINCT seed AS run FROM runs), (SELECT unnest(range(1, 11)) AS epoch) GROUP BY epoch", *RUNS))
def a24_epoch_means(spark, d):
    return long_history(spark, d).groupBy(F.col("epoch").cast("long").alias("epoch")).agg(F.round(F.avg("val_acc"), 9).alias("mean_val_acc"))


PAIRS = "(SELECT a.seed, a.ood_acc AS a, b.ood_acc AS b, b.ood_acc - a.ood_acc AS diff FROM (SELECT * FROM runs WHERE base = 'a') a JOIN (SELECT * FROM runs WHERE base = 'b') b USING (seed))"


@query(sql(f"SELECT seed, a, b, round(diff, 9) AS diff FROM {PAIRS}", *RUNS))
def r02_seed_pivot(spark, d):
    return X.paired(runs(spark, d)).withColumn("diff", F.round("diff", 9))


@query(sql(f"SELECT count(*) AS n, round(avg(diff), 9) AS mean_diff, round(stddev_samp(diff), 9) AS std_diff, count(*) FILTER (WHERE diff > 0) AS wins, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 9) AS t FROM {PAIRS}", *RUNS))
def e02_paired_difference(spark, d):
    out = X.paired_stats(X.paired(runs(spark, d)))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_diff", "std_diff", "t")})


#: Two-sided p of a paired t statistic over n pairs, by the finite sums for whole degrees of freedom.
STUDENT = """SELECT {by}n, round(t, 9) AS t, round(CASE WHEN v % 2 = 0 THEN 1 - sin * s ELSE 1 - 2 / pi() * (asin(sin) + sin * sqrt(c) * s) END, 9) AS p FROM (SELECT *, coalesce(list_sum(list_transform(range(0, v // 2),
    lambda k: pow(c, k) * CASE WHEN v % 2 = 0 THEN exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) ELSE exp(lgamma(k + 1) - lgamma(k + 1.5)) * sqrt(pi()) / 2 END)), 0) AS s
    FROM (SELECT *, n - 1 AS v, (n - 1) / (n - 1 + t * t) AS c, abs(t) / sqrt(n - 1 + t * t) AS sin FROM ({tests})))"""
T_OF = "avg(diff) / nullif(stddev_samp(diff) / sqrt(count(diff)), 0)"


@query(sql(STUDENT.format(by="", tests=f"SELECT count(diff) AS n, {T_OF} AS t FROM {PAIRS}"), *RUNS))
def e03_paired_t(spark, d):
    return X.paired_t(X.paired(runs(spark, d)), []).select("n", F.round("t", 9).alias("t"), F.round("p", 9).alias("p"))


@query(sql(STUDENT.format(by="game_name, ", tests=f"SELECT game_name, count(diff) AS n, {T_OF} AS t FROM (SELECT game_name, CAST(label = pred_b AS INTEGER) - CAST(label = pred_a AS INTEGER) AS diff FROM labelled) GROUP BY 1"), "reviews", "labelled"))
def e03_paired_t_by_game(spark, d):
    """Is model b right more often than a on a game's reviews? Hits are paired by review."""
    hit = lambda c: (F.col("label") == F.col(c)).cast("int")
    rows = labelled(spark, d).select("game_name", (hit("pred_b") - hit("pred_a")).alias("diff"))
    return X.paired_t(rows, ["game_name"]).select("game_name", "n", F.round("t", 9).alias("t"), F.round("p", 9).alias("p"))


@query()
def e03_e04_paired_tests(spark, d):
    return X.paired_tests(X.paired(runs(spark, d)))


@query(sql(f"""SELECT count(*) AS n, coalesce(sum(CASE WHEN diff > 0 THEN r END), 0.0) AS w_plus, coalesce(sum(CASE WHEN diff < 0 THEN r END), 0.0) AS w_minus FROM (
    SELECT diff, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM (SELECT diff, round(abs(diff), 9) AS s FROM {PAIRS}) WHERE s <> 0)""", *RUNS))
def e04_signed_ranks(spark, d):
    return X.signed_ranks(X.paired(runs(spark, d))).select("n", "w_plus", "w_minus")


@query(sql("SELECT base, seed, ood_acc, round(avg(ood_acc) OVER w, 9) AS mean, round(avg(ood_acc) OVER w - stddev_samp(ood_acc) OVER w, 9) AS low, round(avg(ood_acc) OVER w + stddev_samp(ood_acc) OVER w, 9) AS high FROM runs WINDOW w AS (PARTITION BY base)", *RUNS))
def e05_seed_plot(spark, d):
    rows = runs(spark, d)
    bands = rows.groupBy("base").agg(F.avg("ood_acc").alias("m"), F.stddev_samp("ood_acc").alias("s"))
    return rows.join(bands, "base").select("base", "seed", "ood_acc", F.round("m", 9).alias("mean"), F.round(F.col("m") - F.col("s"), 9).alias("low"), F.round(F.col("m") + F.col("s"), 9).alias("high"))


@query(sql("""SELECT data_size, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM (SELECT data_size, 'test_acc' AS metric, test_acc AS value FROM curve
    UNION ALL SELECT data_size, 'val_acc', val_acc FROM curve) GROUP BY 1, 2""", *CURVE))
def e11_curve_plot(spark, d):
    rows = X.long_metrics(curve(spark, d), ["data_size"], ["test_acc", "val_acc"])
    return rows.groupBy("data_size", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))


@query(sql("SELECT base, seed, ood_acc FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ood_acc, seed) AS r, count(*) OVER (PARTITION BY base) AS n FROM runs) WHERE r = n // 2 + 1", *RUNS))
def w06_representative_run(spark, d):
    return X.representative(runs(spark, d), ["base"], "ood_acc", "seed").select("base", "seed", "ood_acc")


#: An epoch gains if it beats every one before; training stops once three in a row don't.
STOPPING = """h AS (SELECT run, epoch, CAST((run * 31 + epoch * epoch * 17) % 23 AS DOUBLE) AS v FROM (SELECT DISTINCT seed AS run FROM runs), (SELECT unnest(range(1, 11)) AS epoch)),
    g AS (SELECT *, coalesce(v > max(v) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS gain FROM h),
    l AS (SELECT *, max(CASE WHEN gain THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last_gain FROM g),
    s AS (SELECT run, coalesce(min(CASE WHEN epoch - last_gain >= 3 THEN epoch END), max(epoch)) AS stop_epoch FROM l GROUP BY run)
    SELECT l.run, s.stop_epoch, max(CASE WHEN gain THEN epoch END) AS best_epoch FROM l JOIN s ON s.run = l.run WHERE epoch <= stop_epoch GROUP BY 1, 2"""


@query(sql("SELECT 1", *RUNS).replace(" SELECT 1", ", " + STOPPING))
def w14_early_stopping(spark, d):
    out = X.early_stopping(long_history(spark, d))
    return out.select("run", F.col("stop_epoch").cast("long").alias("stop_epoch"), F.col("best_epoch").cast("long").alias("best_epoch"))


@query(sql("SELECT r.seed, r.base FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.seed = r.seed AND o.base = r.base AND o.seed % 3 = 0)", *RUNS))
def s14_new_rows(spark, d):
    rows = runs(spark, d).select("seed", "base")
    return X.pending(rows, rows.where("seed % 3 = 0"), "seed", "base")


@query(sql("SELECT DISTINCT seed FROM runs WHERE seed NOT IN (SELECT seed FROM runs WHERE ood_acc >= 80)", *RUNS))
def s16_resume(spark, d):
    rows = runs(spark, d)
    return X.pending(rows.select("seed").distinct(), rows.where("ood_acc >= 80").select("seed"), "seed")
