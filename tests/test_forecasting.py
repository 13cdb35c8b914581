"""Forecasts against a plain penalised solve of the full design matrix."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from gleanery.operators import forecasting as D

DAY = datetime.date(2024, 1, 1)


def series():
    r = np.random.default_rng(0)
    out = []
    for g, (a, b) in {"rising": (20, 0.5), "flat": (50, 0.0), "falling": (90, -0.6)}.items():
        for k in range(70):
            date = DAY + datetime.timedelta(days=k)
            bend = 1.2 * max(0, k - 35) if g == "rising" else 0
            out.append((g, date, float(a + b * k + bend + 8 * (date.isoweekday() == 6) + r.normal())))
    return out


def by_hand(rows, horizon):
    dates, y = [d for _, d, _ in rows], np.array([v for *_, v in rows])
    span = (dates[-1] - dates[0]).days

    def x(d):
        t = (d - dates[0]).days / max(span, 1)
        return [1, t, *[max(t - c, 0) for c in (0.16, 0.32, 0.48, 0.64, 0.8)], *[float(d.isoweekday() == k) for k in (1, 2, 3, 4, 5, 6)]]

    a, n = np.array([x(d) for d in dates], float), len(y)
    # the penalty as further rows of the design
    extra = np.diag(np.sqrt([0, 0] + [0.05 * n] * 5 + [0.05 * n / 7] * 6))
    full = np.vstack([a, extra])
    beta = np.linalg.lstsq(full, np.concatenate([y, np.zeros(13)]), rcond=None)[0]
    inv = np.linalg.pinv(full.T @ full)
    freedom = n - np.trace(inv @ a.T @ a)
    sigma = np.sqrt(((y - a @ beta) ** 2).sum() / freedom) if freedom > 1e-9 else 0.0
    out = {}
    for k in range(1, horizon + 1):
        d = dates[-1] + datetime.timedelta(days=k)
        v = np.array(x(d))
        half = 1.2815515655446004 * sigma * np.sqrt(1 + v @ inv @ v)
        out[d] = (max(v @ beta, 0), max(v @ beta - half, 0), max(v @ beta + half, 0))
    return out, (beta[1:7].sum() / max(span, 1), beta[1] / max(span, 1))


def test_forecast_and_slopes_equal_a_plain_solve(spark):
    data = series()
    df = spark.createDataFrame(data, "topic string, date date, n double").repartition(4)
    got = D.forecast(df, ["topic"], 10).collect()
    slopes = {r.topic: (r.slope, r.early_slope) for r in D.slopes(df, ["topic"]).collect()}
    assert len(got) == 30
    for g in ("rising", "flat", "falling"):
        want, slope = by_hand([r for r in data if r[0] == g], 10)
        assert np.allclose(slopes[g], slope, atol=1e-7)
        for r in got:
            if r.topic == g:
                assert np.allclose((r.forecast, r.low, r.high), want[r.date], atol=1e-6) and r.low <= r.forecast <= r.high
    assert slopes["rising"][0] > 1.0 > slopes["rising"][1] > slopes["flat"][0] + 0.2 and slopes["falling"][0] < -0.4


def test_backtest_beside_the_naive_value(spark):
    df = spark.createDataFrame(series(), "topic string, date date, n double")
    got = {r.topic: r for r in D.backtest(df, ["topic"], 7).collect()}
    rows = [r for r in series() if r[0] == "rising"]
    want, _ = by_hand(rows[:-7], 7)
    error = np.mean([abs(want[d][0] - v) for _, d, v in rows[-7:]])
    naive = np.mean([abs(rows[-14 + i][2] - rows[-7 + i][2]) for i in range(7)])
    r = got["rising"]
    assert r.days == 7 and abs(r.error - error) < 1e-6 and abs(r.naive_error - naive) < 1e-9 and r.error < r.naive_error
    long = {r.topic: r for r in D.backtest(df, ["topic"], 10).collect()}
    assert all(x.days == 10 and 0 <= x.inside <= 1 for x in long.values())


def test_odd_series(spark):
    rows = [("one", DAY, 5.0), ("gap", DAY, 1.0), ("gap", DAY + datetime.timedelta(days=9), None), ("gap", DAY + datetime.timedelta(days=3), 2.0), (None, DAY, 3.0)]
    df = spark.createDataFrame(rows, "topic string, date date, n double")
    got = D.forecast(df, ["topic"], 2).collect()
    assert {r.topic for r in got} == {"one", "gap"} and all(np.isfinite([r.forecast, r.low, r.high]).all() for r in got)
    assert [round(r.forecast, 6) for r in got if r.topic == "one"] == [5.0, 5.0] or all(0 <= r.forecast <= 10 for r in got if r.topic == "one")
    assert D.forecast(df.where("false"), ["topic"]).collect() == [] and D.backtest(df, ["topic"]).collect() == []
    zero = df.withColumn("n", F.lit(0.0))
    assert {r.forecast for r in D.forecast(zero, ["topic"]).collect()} == {0.0}
