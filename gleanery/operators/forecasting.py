"""Forecasts of daily series: least squares over a trend with change points and weekly terms, intervals and back-tests.

All groups are fitted in one aggregation: sums of products of the terms, a matrix of fixed size for each group however long its series. Those small
rows are solved where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the trend may change, as shares of the series; the last fifth stays straight.
CHANGES = (0.16, 0.32, 0.48, 0.64, 0.8)
WEEKDAYS = 6
TERMS = 2 + len(CHANGES) + WEEKDAYS
#: Weight of keeping the changes and the weekly terms near zero, in squared units of the data; level and slope are free.
PENALTY = 0.05
#: Normal quantile of a central interval of 80 %.
WIDTH = 1.2815515655446004


def terms(date: Column, first: Column, last: Column) -> list[Column]:
    """Level, slope over the series' span, change points, and six of seven weekdays (Sunday is the level)."""
    t = F.datediff(date, first) / F.greatest(F.datediff(last, first), F.lit(1))
    return [F.lit(1.0), t, *[F.greatest(t - c, F.lit(0.0)) for c in CHANGES], *[(F.dayofweek(date) == d).cast("double") for d in range(2, 2 + WEEKDAYS)]]


def _terms_of(day: int, weekday: int, span: int) -> np.ndarray:
    t = day / max(span, 1)
    return np.array([1.0, t, *[max(t - c, 0.0) for c in CHANGES], *[float(weekday == d) for d in range(2, 2 + WEEKDAYS)]])


def solve(gram: np.ndarray, moment: np.ndarray, squares: float, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, their unscaled covariance, residual deviation) of penalised normal equations."""
    ridge = np.array([0.0, 0.0] + [PENALTY * n] * len(CHANGES) + [PENALTY * n / 7] * WEEKDAYS)
    inverse = np.linalg.pinv(gram + np.diag(ridge))
    weights = inverse @ moment
    left = max(squares - 2 * weights @ moment + weights @ gram @ weights, 0.0)
    freedom = float(n - np.trace(inverse @ gram))
    return weights, inverse, float(np.sqrt(left / freedom)) if freedom > 1e-9 else 0.0


def sums(series: DataFrame, by: list[str], value: str = "n") -> DataFrame:
    """One row a group: its first and last day, rows, and the sums that its fit needs. Days without a row count nothing; null values are left out."""
    rows = series.where(F.col(value).isNotNull())
    spans = rows.groupBy(*by).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    x = terms(F.col("date"), F.col("first"), F.col("last"))
    placed = rows.join(spans, by).select(*by, "first", "last", F.col(value).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(TERMS) for j in range(i, TERMS)]
    return placed.groupBy(*by, "first", "last").agg(F.count("*").alias("rows"), F.sum(F.col("y") * F.col("y")).alias("squares"), *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"m{i}") for i in range(TERMS)], *products)


def _solved(row) -> tuple[np.ndarray, np.ndarray, float, int]:
    gram = np.zeros((TERMS, TERMS))
    for i in range(TERMS):
        for j in range(i, TERMS):
            gram[i, j] = gram[j, i] = getattr(row, f"g{i}_{j}")
    span = (row.last - row.first).days
    return *solve(gram, np.array([getattr(row, f"m{i}") for i in range(TERMS)]), row.squares, row.rows), span


def forecast(series: DataFrame, by: list[str], horizon: int = 7, value: str = "n") -> DataFrame:
    """(by, date, forecast, low, high): the next ``horizon`` days of each group, with central intervals of 80 %; none below zero. A group of one day keeps its level;
    rows without a group or a value are left out."""
    keys = [f for f in series.schema if f.name in by]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                weights, inverse, deviation, span = _solved(row)
                for ahead in range(1, horizon + 1):
                    date = row.last + pd.Timedelta(days=ahead)
                    x = _terms_of(span + ahead, date.isoweekday() % 7 + 1, span)
                    middle, half = float(x @ weights), WIDTH * deviation * float(np.sqrt(1.0 + x @ inverse @ x))
                    out.append((*[getattr(row, k.name) for k in keys], date, max(middle, 0.0), max(middle - half, 0.0), max(middle + half, 0.0)))
            yield pd.DataFrame(out, columns=[*[k.name for k in keys], "date", "forecast", "low", "high"])

    schema = ", ".join([*[f"`{k.name}` {k.dataType.simpleString()}" for k in keys], "date date, forecast double, low double, high double"])
    return sums(series, by, value).mapInPandas(run, schema)


def slopes(series: DataFrame, by: list[str], value: str = "n") -> DataFrame:
    """(by, slope, early_slope): change a day at the end of each series and at its start; a rise that begins shows in the first before the mean moves."""
    keys = [f for f in series.schema if f.name in by]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                weights, _, _, span = _solved(row)
                out.append((*[getattr(row, k.name) for k in keys], float(weights[1 : 2 + len(CHANGES)].sum()) / max(span, 1), float(weights[1]) / max(span, 1)))
            yield pd.DataFrame(out, columns=[*[k.name for k in keys], "slope", "early_slope"])

    schema = ", ".join([*[f"`{k.name}` {k.dataType.simpleString()}" for k in keys], "slope double, early_slope double"])
    return sums(series, by, value).mapInPandas(run, schema)


def backtest(series: DataFrame, by: list[str], horizon: int = 7, value: str = "n") -> DataFrame:
    """(by, days, error, naive_error, inside): mean absolute error over the last ``horizon`` days of a fit on the days before, beside that of the value a week
    earlier, and the share of days inside the interval. Groups without ``horizon`` and a week more are left out."""
    last = series.groupBy(*by).agg(F.max("date").alias("__end"))
    dated = series.join(last, by)
    past, held = (dated.where(F.datediff("__end", "date") >= horizon).drop("__end"), dated.where(F.datediff("__end", "date") < horizon).drop("__end"))
    naive = past.select(*by, F.col("date").alias("__d"), F.col(value).alias("naive"))
    back = F.ceil((F.datediff("date", "__end") + horizon) / 7) * 7
    week = held.join(last, by).withColumn("__d", F.date_sub("date", back.cast("int"))).join(naive, [*by, "__d"])
    rows = week.join(forecast(past, by, horizon, value), [*by, "date"])
    actual = F.col(value).cast("double")
    return rows.groupBy(*by).agg(
        F.count("*").alias("days"), F.avg(F.abs(F.col("forecast") - actual)).alias("error"), F.avg(F.abs(F.col("naive") - actual)).alias("naive_error"),
        F.avg(actual.between(F.col("low"), F.col("high")).cast("double")).alias("inside"),
    )
