"""Per-ticker indicators. All share the (ticker, date) window of functions.windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import col_of, div, finite, truthy
from ..functions.folds import fold
from ..functions.windows import lag, last_n, lead, rolling, rolling2, running, series

ANNUAL = 252


def ret(n: int = 1, col="close"):
    return div(col_of(col), lag(col, n)) - 1


def lag_n(df: DataFrame, col: str, n: int) -> DataFrame:
    """Row lag (n > 0) or lead (n < 0)."""
    value = lag(col, n) if n >= 0 else lead(col, -n)
    return df.withColumn(f"{col}_{'lag' if n >= 0 else 'lead'}{abs(n)}", value)


def ret_n(df: DataFrame, n: int, col: str = "close") -> DataFrame:
    return df.withColumn(f"ret{n}", ret(n, col))


def log_ret(df: DataFrame, col: str = "close") -> DataFrame:
    ratio = div(col, lag(col))
    return df.withColumn("log_ret", F.when(ratio > 0, F.ln(ratio)))


def sma(df: DataFrame, col: str = "close", n: int = 200, min_periods: int | None = None) -> DataFrame:
    return df.withColumn(f"sma{n}", rolling(F.avg, col, n, min_periods))


def realized_vol(df: DataFrame, n: int, ann: int = ANNUAL) -> DataFrame:
    """Sample deviation of one-row returns times sqrt(ann)."""
    return (
        df.withColumn("_r", ret(1))
        .withColumn(f"vol{n}", rolling(F.stddev_samp, "_r", n) * F.sqrt(F.lit(float(ann))))
        .drop("_r")
    )


def avg_turnover(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn(f"avg_turnover{n}", rolling(F.avg, F.col("close") * F.col("volume"), n))


def avg_volume(df: DataFrame, n: int = 5) -> DataFrame:
    return df.withColumn(f"avg_volume{n}", rolling(F.avg, "volume", n))


def turnover_ratio(df: DataFrame, n: int = 20) -> DataFrame:
    turnover = F.col("close") * F.col("volume")
    return df.withColumn(f"turnover_ratio{n}", div(turnover, rolling(F.avg, turnover, n)))


def price_to_sma(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn(f"price_to_sma{n}", div("close", rolling(F.avg, "close", n)))


def momentum(df: DataFrame, window: int = 252, skip: int = 21) -> DataFrame:
    recent = lag("close", skip) if skip else F.col("close")
    return df.withColumn("mom", div(recent, lag("close", window)) - 1)


def risk_adj_momentum(df: DataFrame, variant: str = "screener", mom: str = "mom",
                      vol: str = "vol60") -> DataFrame:
    """screener: mom / (vol + 1e-6), falling back to mom;
    matrix: mom / vol with a zero or missing vol read as 0.20;
    ratio: mom / vol, missing when vol is zero."""
    m, v = F.col(mom), F.col(vol)
    if variant == "screener":
        out = F.coalesce(finite(m / (v + 1e-6)), m)
    elif variant == "matrix":
        out = m / F.coalesce(F.nullif(finite(v), F.lit(0.0)), F.lit(0.20))
    elif variant == "ratio":
        out = div(m, v)
    else:
        raise ValueError(f"unknown variant {variant}")
    return df.withColumn("risk_adj_mom", out)


def rsi(df: DataFrame, col: str = "close", n: int = 14) -> DataFrame:
    """Simple-mean RSI with an epsilon of 1e-10 in the denominator."""
    return (
        df.withColumn("_d", F.col(col) - lag(col))
        .withColumn("_g", rolling(F.avg, F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0))), n))
        .withColumn("_l", rolling(F.avg, F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0))), n))
        .withColumn(f"rsi{n}", 100.0 - 100.0 / (1.0 + F.col("_g") / (F.col("_l") + 1e-10)))
        .drop("_d", "_g", "_l")
    )


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range; the previous close is taken within the ticker."""
    pc = lag("close")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    return df.withColumn("tr", tr).withColumn(f"atr{n}", rolling(F.avg, "tr", n))


def exec_gap(df: DataFrame) -> DataFrame:
    return df.withColumn("exec_gap", div(lead("open"), "close") - 1)


def drawdown(df: DataFrame, col: str, key="ticker", order="date", base: float | None = None) -> DataFrame:
    """Running peak and fall from it; `base` puts the starting capital into the peak."""
    peak = running(F.max, col, key, order)
    if base is not None:
        peak = F.greatest(peak, F.lit(float(base)))
    return df.withColumn("peak", peak).withColumn("drawdown", div(col, "peak") - 1)


def growth(df: DataFrame, ret_col: str, key="ticker", order="date", out: str = "growth") -> DataFrame:
    """Compounded growth of 1; a missing return counts as zero."""
    return df.withColumn(out, running(F.product, 1 + F.coalesce(F.col(ret_col), F.lit(0.0)), key, order))


def rolling_beta(df: DataFrame, y: str, x: str, n: int, key="ticker") -> DataFrame:
    cov = rolling2(F.covar_samp, y, x, n, key)
    var = rolling2(lambda a, b: F.var_samp(F.when(a.isNotNull(), b)), y, x, n, key)
    return df.withColumn(f"beta{n}", div(cov, var))


def rolling_corr(df: DataFrame, y: str, x: str, n: int, key="ticker") -> DataFrame:
    return df.withColumn(f"corr{n}", finite(rolling2(F.corr, y, x, n, key)))


def breakout(df: DataFrame, n: int = 20) -> DataFrame:
    """Close above the highest high of the n rows before."""
    w = series().rowsBetween(-n, -1)
    full = F.count("high").over(w) == n
    return df.withColumn("breakout", truthy(full & (F.col("close") > F.max("high").over(w))))


def contraction(df: DataFrame, n: int = 20, median_n: int = 50) -> DataFrame:
    """Bollinger band width below its own median."""
    return (
        df.withColumn("bb_width", div(4.0 * rolling(F.stddev_samp, "close", n), rolling(F.avg, "close", n)))
        .withColumn("bb_median", rolling(lambda c: F.percentile(c, F.lit(0.5)), "bb_width", median_n))
        .withColumn("contraction", truthy(F.col("bb_width") < F.col("bb_median")))
    )


def vhf(df: DataFrame, n: int = 28) -> DataFrame:
    """Vertical horizontal filter: close range over the sum of absolute changes."""
    return (
        df.withColumn("_d", F.abs(F.col("close") - lag("close")))
        .withColumn(
            f"vhf{n}",
            div(rolling(F.max, "close", n) - rolling(F.min, "close", n), rolling(F.sum, "_d", n)),
        )
        .drop("_d")
    )


def kama(df: DataFrame, n: int = 10, fast: int = 2, slow: int = 30) -> DataFrame:
    """Kaufman adaptive average, started at the close of row n + 1.

    The recursion k = k + c * (close - k) is folded in the JVM over a ticker's
    array, which is bounded by the calendar.
    """
    fast_c, slow_c = 2.0 / (fast + 1), 2.0 / (slow + 1)
    eff = div(F.abs(F.col("close") - lag("close", n)), rolling(F.sum, "_d", n))
    sc = F.pow(F.coalesce(eff, F.lit(0.0)) * (fast_c - slow_c) + slow_c, F.lit(2.0))
    rows = (
        df.withColumn("_d", F.abs(F.col("close") - lag("close")))
        .withColumn("_c", F.when(lag("close", n).isNotNull(), sc))
        .groupBy("ticker")
        .agg(F.array_sort(F.collect_list(F.struct("date", "close", F.col("_c").alias("c")))).alias("rows"))
    )

    def step(k, r):
        new = F.when(r["c"].isNull(), F.lit(None).cast("double")).when(k.isNull(), r["close"]).otherwise(k + r["c"] * (r["close"] - k))
        return new, new

    folded = fold(F.col("rows"), F.lit(None).cast("double"), "double", "double", step)
    out = rows.withColumn("k", folded).select(
        "ticker", F.explode(F.arrays_zip("rows", "k")).alias("z")
    ).select("ticker", F.col("z.rows.date").alias("date"), F.col("z.k").alias("kama"))
    return df.join(out, ["ticker", "date"])


def rolling_z(df: DataFrame, col: str = "close", n: int = 252) -> DataFrame:
    return df.withColumn(
        f"z{n}", div(F.col(col) - rolling(F.avg, col, n), rolling(F.stddev_samp, col, n))
    )


def breakout_entry(ind: DataFrame, regime: DataFrame, z_min: float = 0.0, vhf_min: float = 0.20,
                   volume_ratio: float = 1.0, min_price: float = 10.0,
                   min_turnover: float = 20000.0) -> DataFrame:
    """Nine conditions at once over breakout, contraction, trend, liquidity and regime.

    `ind` carries breakout, contraction, vhf28, kama, z252, sma200, avg_turnover20
    and avg_volume20; `regime` carries date and bullish.
    """
    flags = [
        F.col("breakout"), F.col("contraction"), F.col("vhf28") > vhf_min,
        F.col("close") > F.col("kama"), F.col("z252") > z_min,
        F.col("close") > F.col("sma200"),
        F.col("volume") > volume_ratio * F.col("avg_volume20"),
        (F.col("close") > min_price) & (F.col("avg_turnover20") > min_turnover),
        F.col("bullish"),
    ]
    joined = ind.join(regime.select("date", "bullish"), "date", "left")
    met = sum((F.when(truthy(f), 1).otherwise(0) for f in flags), F.lit(0))
    return joined.withColumn("conditions_met", met).withColumn("entry", F.col("conditions_met") == len(flags))


def edges(df: DataFrame, flag: str) -> DataFrame:
    """True on the first row of every run of a flag."""
    return df.withColumn(f"{flag}_edge", truthy(flag) & ~truthy(lag(flag)))


def single_name_flags(ind: DataFrame, regime: DataFrame, floor: float = 0.20) -> DataFrame:
    """full_buy / bear_buy / cash for every row of one or many names."""
    j = ind.join(regime.select("date", "bullish"), "date", "left")
    trend = truthy(F.col("close") > F.col("sma200"))
    strong = truthy(F.col("mom") > floor)
    bull = truthy("bullish")
    return (
        j.withColumn("full_buy", bull & trend & truthy(F.col("mom") > 0))
        .withColumn("bear_buy", ~bull & trend & strong)
        .withColumn("cash", ~F.col("full_buy") & ~F.col("bear_buy"))
    )


def return_sequence(df: DataFrame, n: int = 21) -> DataFrame:
    """The last n one-row returns as an array, NULL until n exist."""
    w = last_n(n)
    return (
        df.withColumn("_r", ret(1))
        .withColumn("seq", F.when(F.count("_r").over(w) == n, F.collect_list("_r").over(w)))
        .drop("_r")
    )


def limit_move(df: DataFrame, days: int = 5, limit: float = 0.09) -> DataFrame:
    """An absolute one-row move above the limit within the last `days` closes."""
    r = F.abs(ret(1))
    return (
        df.withColumn("_r", r)
        .withColumn("limit_move", truthy(F.max("_r").over(last_n(days - 1)) > limit))
        .drop("_r")
    )


def monthly_compound(df: DataFrame, ret_col: str, key: str = "ticker") -> DataFrame:
    return df.groupBy(key, F.trunc("date", "month").alias("month")).agg(
        (F.product(1 + F.coalesce(F.col(ret_col), F.lit(0.0))) - 1).alias("month_ret")
    )
