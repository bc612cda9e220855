"""No look-ahead, weight sums, plan shape."""

import pytest
from pyspark.sql import functions as F

from barloom.catalog import frames as X
from barloom.operators import indicators as I
from barloom.plans.screen import screen_indicators
from barloom.sources import adapters as A


def test_indicators_ignore_the_future(spark, sf):
    b = A.bars(spark, sf)
    cut = F.lit("1999-06-30").cast("date")
    bent = b.withColumn("close", F.when(F.col("date") > cut, F.col("close") * 3).otherwise(F.col("close")))
    cols = ["sma200", "mom", "vol60", "avg_turnover20", "ret5"]
    pick = lambda df: {(r.ticker, r.date): tuple(r[c] for c in cols) for r in screen_indicators(df).where(F.col("date") <= cut).collect()}
    assert pick(b) == pick(bent)


def test_book_weights_sum_to_one_and_respect_the_cap(spark, sf):
    book = X.book(spark, sf).groupBy("date").agg(F.sum("weight").alias("s"), F.max("weight").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert book
    for r in book:
        if r.n >= 4:
            assert r.s == pytest.approx(1.0)
            assert r.m <= 0.30 + 1e-9


def test_stacked_indicators_share_one_exchange(spark, sf):
    ind = I.atr(screen_indicators(A.bars(spark, sf)), 14)
    plan = ind._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1


def test_scan_is_pruned_and_filtered(spark, sf, tmp_path):
    from barloom.sources import tables as S
    path = str(tmp_path / "bars")
    S.write_bars(A.bars(spark, sf), path)
    plan = S.last_close(S.read_bars(spark, path), "S0000000007")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ticker,S0000000007)" in plan
    assert "high" not in plan.split("ReadSchema")[1]


def test_no_cross_joins(spark, sf):
    from barloom import catalog
    qs, _ = catalog.load()
    for name in ("prt06_cap_weights", "fac13_beta_cap", "rob08_one_at_a_time", "jn12_cross_configs", "ing15_ffill", "led01_replay_cash", "ml05_score_linear"):
        plan = qs[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
