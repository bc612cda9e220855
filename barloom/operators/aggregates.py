"""Group aggregates of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import div
from ..functions.orderstats import quantiles
from ..sources.scratch import cut


def group_mean(df: DataFrame, keys, col: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(col).alias(f"mean_{col}"))


def median_mad(df: DataFrame, keys, col: str) -> DataFrame:
    """Exact median and median absolute deviation, the sample deviation when the MAD is zero.

    The keys and the one column are written first: three passes read them.
    """
    keys = list(keys)
    df = cut(df.select(*keys, col), "mad")
    med = quantiles(df, keys, col, {"median": 0.5})
    dev = df.join(med, keys) if keys else df.withColumn("median", med.select("median").scalar())
    dev = dev.withColumn("_d", F.abs(F.col(col) - F.col("median")))
    mad = quantiles(dev, keys, "_d", {"mad": 0.5})
    sd = df.groupBy(*keys).agg(F.stddev_samp(col).alias("_sd"))
    if keys:
        j = med.join(mad, keys).join(sd, keys)
    else:
        j = med.withColumn("mad", mad.scalar()).withColumn("_sd", sd.scalar())
    return j.select(*keys, "median", F.when(F.col("mad") != 0, F.col("mad")).otherwise(F.col("_sd")).alias("mad"))


def first_last(df: DataFrame, keys, col: str, order: str = "date") -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(col, order).alias("first"), F.max_by(col, order).alias("last"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def win_loss_sums(trades: DataFrame, pnl: str = "pnl", keys=("strategy",)) -> DataFrame:
    p = F.col(pnl)
    return trades.groupBy(*keys).agg(
        F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("gross_profit"),
        F.sum(F.when(p < 0, p).otherwise(0.0)).alias("gross_loss"),
    )


def exposure_totals(signals: DataFrame, threshold: float = 0.001, keys=()) -> DataFrame:
    p = F.col("position")
    return signals.groupBy(*keys).agg(
        F.sum(F.abs(p)).alias("gross"), F.sum(p).alias("net"),
        F.sum(p * F.coalesce("beta", F.lit(0.0))).alias("beta_exposure"),
        F.count_if(p > threshold).alias("longs"), F.count_if(p < -threshold).alias("shorts"),
    )


def sector_exposure(signals: DataFrame, sector_map: DataFrame, default: str = "Other") -> DataFrame:
    j = signals.join(sector_map, "ticker", "left")
    return j.groupBy(F.coalesce("sector", F.lit(default)).alias("sector")).agg(
        F.sum("position").alias("exposure")
    )


def monthly_sum(df: DataFrame, col: str, date: str = "date", keys=()) -> DataFrame:
    return df.groupBy(*keys, F.trunc(date, "month").alias("month")).agg(F.sum(col).alias("total"))


def month_end_change(df: DataFrame, cols: list[str], base: float, keys=("portfolio",)) -> DataFrame:
    """Last value of each month and its change; the first month is measured against base."""
    keys = list(keys)
    per = df.groupBy(*keys, F.trunc("date", "month").alias("month")).agg(
        *[F.max_by(c, "date").alias(c) for c in cols]
    )
    w = W.partitionBy(*keys).orderBy("month")
    for c in cols:
        prev = F.coalesce(F.lag(c).over(w), F.lit(float(base)))
        per = per.withColumn(f"{c}_change", (div(c, prev) - 1) * 100)
    return per


def ols_agg(df: DataFrame, y: str, x: str, keys=()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.covar_samp(y, x).alias("cov"), F.var_samp(x).alias("var_x"),
        F.regr_count(y, x).alias("n"),
    )


def sector_stats(signals: DataFrame, score: str) -> DataFrame:
    return signals.groupBy("sector").agg(
        F.count(F.lit(1)).alias("names"), F.avg(score).alias("avg_score"),
        F.count_if(F.col(score) > 0).alias("positive"),
    )


def pivot_metric(results: DataFrame, rows: str, cols: str, metric: str, values: list) -> DataFrame:
    return results.groupBy(rows).pivot(cols, values).agg(F.first(metric))
