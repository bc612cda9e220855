"""Exact ranks and quantiles against brute force on skewed data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.orderstats import pct_rank, quantiles, value_ranks


def skewed(seed=3, n=6000):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 9, n))
    x = np.where(rng.random(n) < 0.35, 7.0, rng.normal(0, 1e3, n).round(2))
    return pd.DataFrame({"key": key, "x": x, "id": np.arange(n)})


def test_pct_rank_equals_pandas(spark):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    got = pct_rank(df, "x", ("key",)).toPandas().set_index("id")["pct_rank"].sort_index()
    want = pdf.groupby("key").x.rank(pct=True)
    np.testing.assert_allclose(got.values, want.values, rtol=0, atol=1e-12)


def test_pct_rank_whole_table(spark):
    pdf = skewed(4)
    got = pct_rank(spark.createDataFrame(pdf), "x", ()).toPandas().set_index("id")["pct_rank"].sort_index()
    np.testing.assert_allclose(got.values, pdf.x.rank(pct=True).values, rtol=0, atol=1e-12)


def test_quantiles_equal_pandas(spark):
    pdf = skewed(5)
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.77, "e": 1.0}
    got = quantiles(spark.createDataFrame(pdf), ["key"], "x", qs).toPandas().set_index("key").sort_index()
    for name, q in qs.items():
        np.testing.assert_allclose(got[name].values, pdf.groupby("key").x.quantile(q).values, rtol=1e-12)
    one = quantiles(spark.createDataFrame(pdf), [], "x", {"m": 0.5}).first().m
    assert one == pytest.approx(pdf.x.median())


def test_nulls_are_left_out_and_single_rows_work(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), ("c", 2.0), ("c", 4.0)], "key string, x double")
    got = {r.key: r.m for r in quantiles(df, ["key"], "x", {"m": 0.5}).collect()}
    assert got == {"a": 1.0, "c": 3.0}
    assert {r.v: r.first_rank for r in value_ranks(df, [], "x").collect()} == {1.0: 1, 2.0: 2, 4.0: 3}


def test_limit_is_pushed_below_the_shuffle(spark):
    from pyspark.sql import Window as W
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    w = W.partitionBy("k").orderBy("id")
    plan = df.withColumn("r", F.row_number().over(w)).where("r <= 15")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_expanding_quantile_equals_pandas(spark):
    pdf = skewed(6, 3000)
    pdf["date"] = (pd.to_datetime("2020-01-01") + pd.to_timedelta(pdf.id % 12 * 30, "D")).dt.date
    df = spark.createDataFrame(pdf)
    cuts = df.agg(F.array_sort(F.collect_set("date"))).scalar()
    from barloom.functions.orderstats import expanding_quantile
    got = {(r.key, r.cutoff): r.m for r in expanding_quantile(df, ["key"], "date", cuts, "x", 0.5, "m").collect()}
    for d in sorted(set(pdf.date))[1:]:
        for k, v in pdf[pdf.date < d].groupby("key").x.median().items():
            assert got[(k, d)] == pytest.approx(v)


def test_large_run_settings_follow_the_input():
    from barloom.session import large_run_conf
    assert int(large_run_conf(100, 4000)["spark.sql.shuffle.partitions"]) == 819200
    assert int(large_run_conf(0.001, 16)["spark.sql.shuffle.partitions"]) == 32
