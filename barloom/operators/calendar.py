"""Trading calendar operators. A calendar is a distinct list of dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import asof_join

# Periods per year by rebalance frequency; anything else counts as weekly.
ANN_FACTORS = {
    "D": 252, "B": 252, "W": 52, "W-MON": 52, "W-FRI": 52,
    "M": 12, "MS": 12, "BM": 12, "BMS": 12, "Q": 4, "QS": 4,
}


def calendar(bars: DataFrame) -> DataFrame:
    return bars.select("date").distinct()


def _one_series():
    return W.partitionBy(F.lit(0)).orderBy("date")


def month_end_dates(bars: DataFrame) -> DataFrame:
    """month, date: last trading day of each month (partial aggregate)."""
    return bars.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"))


def rebalance_steps(weights: DataFrame, keys: list[str], dates: DataFrame | None = None) -> DataFrame:
    """keys, date, next_date, step: the rebalance calendar of each configuration.

    dates: the rebalance dates, whatever is held on them; each configuration has
    those from its first holding on. Without it the dates are those of the weights,
    which is right only if the book is never empty. Keys that `dates` has too (a
    year) have calendars of their own. The calendar is one row per
    rebalance, so it travels as one array.
    """
    if dates is None:
        w = W.partitionBy(*keys).orderBy("date")
        return weights.select(*keys, "date").distinct().select(
            *keys, "date", F.lead("date").over(w).alias("next_date"), F.row_number().over(w).alias("step")
        )
    own = [k for k in keys if k in dates.columns]
    w = W.partitionBy(*own, F.lit(0)).orderBy("date")
    cal = dates.select(*own, "date").distinct().select(
        *own, "date", F.lead("date").over(w).alias("next_date"), F.row_number().over(w).alias("step")
    )
    every = F.array_sort(F.collect_list(F.struct("date", "next_date", "step"))).alias("_all")
    first = weights.groupBy(*keys).agg(F.min("date").alias("_first"))
    first = first.join(cal.groupBy(*own).agg(every), own) if own else first.withColumn("_all", cal.agg(every).scalar())
    later = F.filter("_all", lambda x: x["date"] >= F.col("_first"))
    return first.select(*keys, F.explode(later).alias("c")).select(*keys, "c.date", "c.next_date", "c.step")


def week_end_dates(bars: DataFrame) -> DataFrame:
    week = F.to_date(F.date_trunc("week", F.col("date")))
    return bars.groupBy(week.alias("week")).agg(F.max("date").alias("date"))


def next_trading_day(cal: DataFrame) -> DataFrame:
    """date, exec_date: the following trading day, the same day at the end.

    A calendar has one row per day, so the single-partition window is a few
    thousand rows at any data size.
    """
    return cal.select("date").distinct().select(
        "date", F.coalesce(F.lead("date").over(_one_series()), F.col("date")).alias("exec_date")
    )


def snap_to_trading_day(schedule: DataFrame, cal: DataFrame) -> DataFrame:
    """target, date: the last trading day on or before each target."""
    asks = schedule.select(F.lit(0).alias("k"), F.col("target"))
    facts = cal.select(F.lit(0).alias("k"), F.col("date").alias("target"), "date")
    return asof_join(asks, facts, ["k"], "target").select("target", "date")


def holding_periods(rebalance: DataFrame, cal: DataFrame) -> DataFrame:
    """date (signal), exec_date, next_date, next_exec per rebalance."""
    j = rebalance.select("date").distinct().join(next_trading_day(cal), "date")
    return j.select(
        "date", "exec_date",
        F.lead("date").over(_one_series()).alias("next_date"),
        F.lead("exec_date").over(_one_series()).alias("next_exec"),
    ).where(F.col("next_date").isNotNull())


def weekday_schedule(span: DataFrame, weekday: int = 0) -> DataFrame:
    """target: every given weekday (0 = Monday) between span.start and span.end."""
    first = F.date_add("start", F.pmod(F.lit(weekday) - F.weekday("start"), F.lit(7)))
    ok = first <= F.col("end")
    return span.where(ok).select(
        F.explode(F.sequence(first, F.col("end"), F.expr("interval 7 days"))).alias("target")
    )


def trading_grid(cal: DataFrame, start, today: dt.date | None = None) -> DataFrame:
    """Trading days from `start`, plus today when today is a weekday."""
    days = cal.where(F.col("date") >= F.lit(start).cast("date")).select("date")
    if today is not None and today.weekday() < 5:
        days = days.unionByName(cal.sparkSession.range(1).select(F.lit(today).alias("date")))
    return days.distinct()


def monthly_expiry(chain: DataFrame, min_gap: int = 5) -> DataFrame:
    """Per symbol, date and type: last expiry inside the earliest month on offer."""
    from .gates import expiry_min_gap

    far = expiry_min_gap(chain, min_gap)
    months = far.groupBy("symbol", "date", "option_type", F.trunc("expiry_dt", "month").alias("m")).agg(
        F.max("expiry_dt").alias("e")
    )
    return months.groupBy("symbol", "date", "option_type").agg(F.min_by("e", "m").alias("expiry_dt"))


def ann_factor(freq: str) -> int:
    return ANN_FACTORS.get(freq, 52)


def empirical_ann_factor(df: DataFrame, keys=("ticker",)) -> DataFrame:
    """Rows per year of each series."""
    years = F.datediff(F.max("date"), F.min("date")) / F.lit(365.25)
    return df.groupBy(*keys).agg((F.count(F.lit(1)) / F.nullif(years, F.lit(0.0))).alias("rows_per_year"))
