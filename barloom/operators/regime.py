"""Market regime from an index series. Windows are keyed by index_id, one row per date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import div, truthy
from ..functions.windows import lag, rolling, series, to_date_window

# Fixed value: scale of the fallback index of the momentum screen.
FALLBACK_INDEX_SCALE = 10.45


def synthetic_index(bars: DataFrame, scale: float = 1.0, index_id: str = "IDX") -> DataFrame:
    return bars.groupBy("date").agg((F.avg("close") * scale).alias("close")).select(
        F.lit(index_id).alias("index_id"), "date", "close"
    )


def proxy_index(bars: DataFrame, names: DataFrame, index_id: str = "PROXY") -> DataFrame:
    """Mean close of the named constituents."""
    return synthetic_index(bars.join(names, "ticker", "left_semi"), index_id=index_id)


def sma_regime(index_bars: DataFrame, n: int = 100) -> DataFrame:
    """Adds the average and the flag close > average; no flag while warming up."""
    return index_bars.withColumn("sma", rolling(F.avg, "close", n, key="index_id")).withColumn(
        "above", F.col("close") > F.col("sma")
    )


def run_lengths(df: DataFrame, flag: str = "above", key: str = "index_id") -> DataFrame:
    """Length of the current run of a flag: change marks, their running sum names
    the run, the row number inside the run is its length. Missing flags are skipped."""
    rows = df.where(F.col(flag).isNotNull())
    changed = F.when(F.col(flag) == lag(flag, 1, key), 0).otherwise(1)
    return (
        rows.withColumn("_c", changed)
        .withColumn("run_id", F.sum("_c").over(to_date_window(key)))
        .withColumn("run_len", F.row_number().over(W.partitionBy(key, "run_id").orderBy("date")))
        .drop("_c")
    )


def hysteresis(df: DataFrame, flag: str = "above", confirm: int = 3, key: str = "index_id") -> DataFrame:
    """State that turns only after `confirm` rows on one side; starts False."""
    runs = run_lengths(df, flag, key)
    confirmed = F.when(F.col("run_len") >= confirm, F.col(flag))
    return runs.withColumn(
        "bullish", F.coalesce(F.last(confirmed, ignorenulls=True).over(to_date_window(key)), F.lit(False))
    )


def bull_streak(df: DataFrame, flag: str = "above") -> DataFrame:
    """Rows above the average in a row, zero when the state is not bullish or on a dip."""
    return df.withColumn(
        "streak", F.when(truthy("bullish") & truthy(flag), F.col("run_len")).otherwise(0)
    )


def abs_momentum_regime(index_bars: DataFrame, n: int = 126) -> DataFrame:
    r = div("close", lag("close", n, "index_id")) - 1
    return index_bars.withColumn("abs_mom", r).withColumn("bullish", truthy(F.col("abs_mom") > 0))


def attach_regime(bars: DataFrame, regime: DataFrame) -> DataFrame:
    return bars.join(regime.select("date", "bullish"), "date", "left").withColumn(
        "bullish", truthy("bullish")
    )


def regime_as_of(dates: DataFrame, regime: DataFrame) -> DataFrame:
    """State on each date, taken from the last index row on or before it."""
    from .joins import asof_join

    out = asof_join(
        dates.withColumn("index_id", F.lit("IDX")),
        regime.withColumn("index_id", F.lit("IDX")).select("index_id", "date", "bullish", "streak"),
        ["index_id"], "date",
    )
    return out.select(
        "date", truthy("bullish").alias("bullish"), F.coalesce("streak", F.lit(0)).alias("streak")
    )


def exposure_scale(regime: DataFrame, full: float = 1.10, reduced: float = 0.55, streak: int = 22) -> DataFrame:
    """0 outside the bull state, reduced early in it, full once the streak is long enough."""
    return regime.withColumn(
        "exposure",
        F.when(~truthy("bullish"), F.lit(0.0))
        .when(F.col("streak") < streak, F.lit(reduced))
        .otherwise(F.lit(full)),
    )


def market_regime(index_bars: DataFrame, n: int = 100, confirm: int = 3) -> DataFrame:
    """index_id, date, close, sma, above, run_len, bullish, streak."""
    return bull_streak(hysteresis(sma_regime(index_bars, n), "above", confirm))
