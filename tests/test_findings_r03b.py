"""Moving frames are worked out where they are asked for, with the values of the plain windows."""

import datetime as dt

from pyspark.sql import functions as F

from barloom.catalog import frames as X
from barloom.catalog import q_ml, q_portfolio
from barloom.functions.windows import rolling, rolling_at
from barloom.operators import calendar as CAL
from barloom.operators import ml as L
from barloom.plans import backtest as BT
from barloom.plans.screen import screen_indicators
from barloom.sources import adapters as A

DAY = dt.date(2020, 1, 1)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def made(spark):
    """A plain series, a flat one, one with missing and infinite values, one without a name, and a row without a date."""
    at = lambda i: DAY + dt.timedelta(days=3 * i)
    rows = [("A", at(i), float(50 + (i * 37) % 23), float(10 + i % 7)) for i in range(300)]
    rows += [("B", at(i), 0.1, 3.0) for i in range(230)]
    rows += [("C", at(i), None if i % 71 == 5 else 0.0 if i % 83 == 7 else 7.0 + i % 5, float(i % 4) or None) for i in range(260)]
    rows += [(None, at(i), 5.0 + i % 3, 1.0) for i in range(90)] + [("A", None, 4.0, 2.0), ("D", at(2), 1.0, 1.0)]
    return spark.createDataFrame(rows, "ticker string, date date, close double, volume double")


def same(got, want):
    key = lambda r: str((r.ticker, r.date))
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and (abs(x - y) <= 1e-9 * max(1, abs(y)) or (x != x and y != y))), (a, b)


def test_stats_at_kept_rows_are_those_of_the_windows(spark):
    df = made(spark).withColumn("keep", F.coalesce(F.dayofmonth("date") % 4 == 0, F.lit(True)))
    stats = {"a": ("avg", "close", 5), "s": ("stddev_samp", "close", 20), "v": ("avg", "volume", 1)}
    names = {"avg": F.avg, "stddev_samp": F.stddev_samp}
    want = df.select("*", *[rolling(names[g], c, n).alias(k) for k, (g, c, n) in stats.items()]).where("keep")
    got = rolling_at(df, "keep", stats, ["ticker", "date", "close"])
    same(got, want.select("ticker", "date", "close", *stats))
    assert {r.s for r in got.where("ticker = 'B' and s is not null").collect()} == {0.0}


def test_month_end_panel_is_that_of_the_screen(spark):
    bars = made(spark)
    last = screen_indicators(bars).groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.max_by(F.struct(*BT.PANEL), "date").alias("r"))
    same(BT.month_end_panel(bars), last.join(CAL.month_end_dates(bars), "month").select("date", "ticker", "r.*"))


def test_feature_matrix_is_that_of_the_windows(spark):
    bars = made(spark)
    due = CAL.month_end_dates(bars)
    want = L.features(bars).join(due.select("date").distinct(), "date", "left_semi").select("date", "ticker", *L.FEATURES)
    same(L.feature_matrix(bars, due), want)


def test_no_moving_frame_of_many_rows_is_gone_through_for_every_row(spark, sf):
    bars = A.bars(spark, sf)
    for df in (q_ml._5(spark, sf), q_ml._6(spark, sf), BT.month_end_panel(bars)):
        assert "-199, currentrow" not in plan(df).lower().replace("$()", "") and "FlatMapGroupsInArrow" in plan(df)


def test_the_panel_of_an_attribution_is_worked_out_once(spark, sf, monkeypatch):
    built = []
    real = X.month_end_panel
    monkeypatch.setattr(X, "month_end_panel", lambda *a: built.append(1) or real(*a))
    q_portfolio.forward(spark, sf)
    assert built == [1]
