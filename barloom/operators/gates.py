"""Filters and gates: universe, eligibility, fundamentals, trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import div, in_market_hours, truthy
from ..functions.orderstats import quantiles
from ..functions.windows import lag, last_n, rolling, series, with_group_stats
from ..schemas import FundamentalLimits


def in_universe(bars: DataFrame, members: DataFrame, extras: tuple[str, ...] = ()) -> DataFrame:
    """Rows of members, plus names added by hand (a literal list)."""
    inside = bars.join(members.select("ticker").distinct().withColumn("_in", F.lit(True)), "ticker", "left")
    keep = truthy("_in")
    if extras:
        keep = keep | F.col("ticker").isin(*extras)
    return inside.where(keep).drop("_in")


def eligible(ind: DataFrame, min_turnover: float, min_price: float = 10.0, sma: str = "sma200") -> DataFrame:
    return ind.where(
        (F.col("close") > F.col(sma)) & (F.col("avg_turnover20") > min_turnover)
        & (F.col("close") > min_price)
    )


def require(ind: DataFrame, cols: list[str]) -> DataFrame:
    return ind.dropna(subset=cols)


def bear_floor(ind: DataFrame, regime: DataFrame, floor: float = 0.20) -> DataFrame:
    """Outside the bull state only momentum above the floor passes."""
    j = ind.join(regime.select("date", "bullish"), "date", "left")
    return j.where(truthy("bullish") | (F.col("mom") > floor))


def winners_on_pullback(ind: DataFrame, q: float = 0.75, pullback: float = -0.02) -> DataFrame:
    """Momentum at or above the date's quantile with a five-row fall."""
    cut = quantiles(ind, ["date"], "mom", {"mom_cut": q})
    return ind.join(cut, "date").where(
        (F.col("mom") >= F.col("mom_cut")) & (F.col("ret5") < pullback)
    )


def expiry_min_gap(chain: DataFrame, days: int = 5) -> DataFrame:
    return chain.where(F.col("expiry_dt") >= F.date_add("date", days))


def date_slice(df: DataFrame, start=None, end=None) -> DataFrame:
    """Inclusive date range; reaches the scan as a partition or row-group filter."""
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def market_hours(df: DataFrame, ts: str = "ts", open_minute: int = 555, close_minute: int = 930) -> DataFrame:
    return df.where(in_market_hours(ts, open_minute, close_minute))


def complete_history(bars: DataFrame) -> DataFrame:
    """Tickers that have a close on every date of the table."""
    dates = bars.agg(F.countDistinct("date").alias("n"))
    full = bars.groupBy("ticker").agg(F.count("close").alias("_n")).where(
        F.col("_n") == dates.scalar()
    )
    return bars.join(full.select("ticker"), "ticker", "left_semi")


def min_history(bars: DataFrame, n: int) -> DataFrame:
    enough = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n)
    return bars.join(enough.select("ticker"), "ticker", "left_semi")


def fundamental_gate(f: DataFrame, limits: FundamentalLimits = FundamentalLimits()) -> DataFrame:
    """First failing rule as reason, NULL when the name passes. Missing values pass."""
    finance = truthy("is_finance")
    rules = [
        ("net_profit_negative", truthy("net_profit_negative")),
        ("ebitda_negative", truthy("ebitda_negative")),
        ("roe_low", truthy(F.col("roe") < limits.roe_min)),
        ("roce_low", truthy(F.col("roce") < limits.roce_min)),
        ("revenue_decline", truthy("revenue_decline_2yr")),
        ("holding_low", truthy(F.col("promoter_holding") < limits.holding_min)),
        ("pledge_high", truthy(F.col("promoter_pledge") > limits.pledge_max)),
        ("pledge_rising", truthy("pledge_increasing_3q")),
        ("market_cap_low", truthy(F.col("market_cap_cr") < limits.market_cap_min)),
        ("auditor_flag", truthy("auditor_flag")),
        ("promoter_selling", truthy("promoter_selling")),
        ("debt_high", ~finance & truthy(F.col("debt_equity") > limits.debt_equity_max)),
        ("icr_low", ~finance & truthy(F.col("icr") < limits.icr_min)),
        ("npa_high", finance & truthy(F.col("gross_npa_pct") > limits.npa_max)),
        ("car_low", finance & truthy(F.col("car_pct") < limits.car_min)),
    ]
    reason = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        reason = F.when(rule, name).otherwise(reason)
    return f.withColumn("reason", reason)


def _as_of(bars: DataFrame, as_of) -> DataFrame:
    return bars if as_of is None else bars.where(F.col("date") <= F.lit(as_of).cast("date"))


def last_state(bars: DataFrame, as_of=None) -> DataFrame:
    """One row per ticker: last close, 50/200 averages, rows, return over 251 rows."""
    rn = F.row_number().over(W.partitionBy("ticker").orderBy(F.col("date").desc()))
    rows = _as_of(bars, as_of).where(F.col("close").isNotNull())
    return (
        rows.withColumn("_rn", rn)
        .groupBy("ticker")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.when(F.col("_rn") == 1, F.col("close"))).alias("close"),
            F.max(F.when(F.col("_rn") == 252, F.col("close"))).alias("base"),
            F.avg(F.when(F.col("_rn") <= 50, F.col("close"))).alias("_s50"),
            F.avg(F.when(F.col("_rn") <= 200, F.col("close"))).alias("_s200"),
        )
        .select(
            "ticker", "n", "close",
            F.when(F.col("n") >= 50, F.col("_s50")).alias("sma50"),
            F.when(F.col("n") >= 200, F.col("_s200")).alias("sma200"),
            (div("close", "base") - 1).alias("ret_12m"),
        )
    )


def trend_gate(bars: DataFrame, as_of=None) -> DataFrame:
    """Reason per ticker: short history, below an average, or a 12-month fall."""
    return last_state(bars, as_of).withColumn(
        "reason",
        F.when(F.col("n") < 200, "short_history")
        .when(F.col("close") < F.col("sma200"), "below_sma200")
        .when(F.col("close") < F.col("sma50"), "below_sma50")
        .when(F.col("ret_12m") < -0.20, "fell_12m"),
    )


def sector_collapse_gate(bars: DataFrame, sector_map: DataFrame, full_bars: DataFrame | None = None,
                         as_of=None) -> DataFrame:
    """Blocks weak names of a falling sector; the sector mean comes from the full universe."""
    full = last_state(full_bars if full_bars is not None else bars, as_of)
    dim = sector_map.select("ticker", "sector")
    sector_of = lambda df: df.join(dim, "ticker", "left").withColumn(
        "sector", F.coalesce("sector", F.lit("Other"))
    )
    means = sector_of(full).groupBy("sector").agg(F.avg("ret_12m").alias("sector_ret"))
    mine = sector_of(last_state(bars, as_of)).join(means, "sector", "left")
    return mine.withColumn(
        "blocked",
        truthy((F.coalesce("sector_ret", F.lit(0.0)) < -0.15) & (F.col("ret_12m") < -0.10)),
    )


def protect_pairs(blocked: DataFrame, pairs: DataFrame) -> DataFrame:
    """A blocked leg blocks its partner as well."""
    b = blocked.select("ticker").distinct()
    legs = pairs.select("pair_id", F.explode(F.array("leg1", "leg2")).alias("ticker"))
    hit = legs.join(b, "ticker", "left_semi").select("pair_id").distinct()
    return legs.join(hit, "pair_id", "left_semi").select("ticker").unionByName(b).distinct()


def apply_block(signals: DataFrame, blocked: DataFrame, fund_blocked: DataFrame, book: DataFrame) -> DataFrame:
    """Zero new entries of blocked names; open positions are left to their exit rules."""
    mark = lambda df, c: df.select("ticker").distinct().withColumn(c, F.lit(True))
    j = (
        signals.join(mark(blocked, "_b"), "ticker", "left")
        .join(mark(fund_blocked, "_f"), "ticker", "left")
        .join(mark(book, "_o"), "ticker", "left")
    )
    hit = truthy("_b") & ~truthy("_o") & (F.abs("position") >= 0.001)
    label = F.when(truthy("_f"), "fundamental_blocked").otherwise("trend_blocked")
    return (
        j.withColumn("_hit", hit)
        .withColumn("signal_type", F.when(F.col("_hit"), label).otherwise(F.col("signal_type")))
        .withColumn("position", F.when(F.col("_hit"), 0.0).otherwise(F.col("position")))
        .drop("_hit", "_b", "_f", "_o")
    )


def volume_confirm(signals: DataFrame, bars: DataFrame, ratio: float = 1.30, n: int = 20) -> DataFrame:
    """Mean-reversion entries need the last volume well above its n-row mean."""
    rn = F.row_number().over(W.partitionBy("ticker").orderBy(F.col("date").desc()))
    live = (
        bars.withColumn("_rn", rn).where(F.col("_rn") <= n).groupBy("ticker")
        .agg(
            F.when(F.count("volume") == n, F.avg("volume")).alias("_av"),
            F.max(F.when(F.col("_rn") == 1, F.col("volume"))).alias("_cv"),
        )
        .select("ticker", div("_cv", "_av").alias("vol_ratio"))
    )
    weak = (F.col("signal_type") == "mean_reversion") & truthy(F.col("vol_ratio") < ratio)
    return signals.join(live, "ticker", "left").withColumn(
        "position", F.when(weak, 0.0).otherwise(F.col("position"))
    )


def filter_funnel(flagged: DataFrame, stages: list[str]) -> DataFrame:
    """Names left after each gate, in order: stage, position in the funnel, count."""
    passed = F.lit(True)
    counts = []
    for s in stages:
        passed = passed & truthy(s)
        counts.append(F.count_if(passed).alias(s))
    wide = flagged.agg(*counts)
    cells = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(s).alias("left"))
        for i, s in enumerate(stages, 1)
    ])
    return wide.select(F.inline(cells))
