"""Returns of holdings tables. A weights table is (config, date, ticker, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import div
from ..functions.windows import lead, series
from .calendar import holding_periods, rebalance_steps
from .joins import asof_join, range_join
from .portfolio import itemised_cost


def open_to_open_label(bars: DataFrame, rebalance: DataFrame, cal: DataFrame) -> DataFrame:
    """date, ticker, label: return between the opens after consecutive rebalances."""
    p = holding_periods(rebalance, cal)
    px = bars.select("ticker", "date", "open")
    start = px.select("ticker", F.col("date").alias("exec_date"), F.col("open").alias("o1"))
    end = px.select("ticker", F.col("date").alias("next_exec"), F.col("open").alias("o2"))
    return p.join(start, "exec_date").join(end, ["ticker", "next_exec"]).select(
        "date", "ticker", (div("o2", "o1") - 1).alias("label")
    )


def basket_return(weights: DataFrame, prices: DataFrame, keys=("config_id",), dates: DataFrame | None = None) -> DataFrame:
    """Mean close-to-close return per rebalance; a missing exit price counts as no move.

    With `dates` a rebalance on which nothing is held has the return 0 of cash.
    """
    keys = list(keys)
    per = rebalance_steps(weights, keys, dates).where(F.col("next_date").isNotNull())
    px = prices.select("ticker", "date", "close")
    rows = (
        weights.join(per, [*keys, "date"])
        .join(px.withColumnRenamed("close", "p0"), ["ticker", "date"])
        .join(px.select("ticker", F.col("date").alias("next_date"), F.col("close").alias("p1")),
              ["ticker", "next_date"], "left")
    )
    r = div(F.coalesce("p1", "p0"), "p0") - 1
    held = rows.groupBy(*keys, "date").agg(F.avg(r).alias("ret"), F.count(F.lit(1)).alias("names"))
    if dates is None:
        return held
    return per.select(*keys, "date").join(held, [*keys, "date"], "left").fillna({"ret": 0.0, "names": 0})


def period_daily_returns(weights: DataFrame, bars: DataFrame, leverage: float = 1.0, keys=("config_id",),
                         dates: DataFrame | None = None, weighted: bool = False) -> DataFrame:
    """Daily return of the held names inside each holding period.

    The mean over all names held, or with `weighted` the sum of weight * return. A
    name without a bar on a day counts as no move, as does its first row in a
    period. With `dates`, periods in cash have rows of 0.
    """
    keys = list(keys)
    per = rebalance_steps(weights, keys, dates).where(F.col("next_date").isNotNull())
    share = F.col("weight") if weighted else 1.0 / F.count(F.lit(1)).over(W.partitionBy(*keys, "date"))
    held = weights.withColumn("_share", share).join(per, [*keys, "date"]).select(
        *keys, "ticker", F.col("date").alias("entry"), "next_date", "_share"
    )
    rows = range_join(held, bars.select("ticker", "date", "close"), "entry", "next_date", "ticker")
    prev = F.lag("close").over(W.partitionBy(*keys, "ticker", "entry").orderBy("date"))
    moved = rows.withColumn("r", F.coalesce(div("close", prev) - 1, F.lit(0.0)))
    daily = moved.groupBy(*keys, "entry", "date").agg((F.sum(F.col("_share") * F.col("r")) * leverage).alias("ret"))
    if dates is None:
        return daily
    periods = per.select(*keys, F.col("date").alias("entry"), "next_date").withColumn("_k", F.lit(0))
    days = range_join(periods, bars.select("date").distinct().withColumn("_k", F.lit(0)), "entry", "next_date", "_k")
    return days.select(*keys, "entry", "date").join(daily, [*keys, "entry", "date"], "left").fillna({"ret": 0.0})


def charge_costs(daily: DataFrame, drag: DataFrame, keys=("config_id",)) -> DataFrame:
    """Subtract the drag of a rebalance on the first day of its period."""
    keys = list(keys)
    first = daily.groupBy(*keys, "entry").agg(F.min("date").alias("date")).join(
        drag.select(*keys, F.col("date").alias("entry"), "drag"), [*keys, "entry"]
    )
    return daily.join(first, [*keys, "entry", "date"], "left").withColumn(
        "net", F.col("ret") - F.coalesce("drag", F.lit(0.0))
    ).drop("drag")


def chained_equity(period_returns: DataFrame, n: int, cost: float, initial: float = 1.0,
                   keys=("config_id",)) -> DataFrame:
    """Capital after each period: c * (1 - swaps * cost / 2n) * (1 + r), chained by a product."""
    step = (1 - F.col("swaps") * cost / (2.0 * n)) * (1 + F.col("ret"))
    w = series(list(keys)).rowsBetween(W.unboundedPreceding, 0)
    return period_returns.withColumn("capital", F.lit(initial) * F.product(step).over(w))


def swap_counts(weights: DataFrame, keys=("config_id",), dates: DataFrame | None = None) -> DataFrame:
    """Names that left plus names that came, per rebalance."""
    from .portfolio import weight_changes

    moved = (F.col("weight") == 0) != (F.col("old_weight") == 0)
    return weight_changes(weights, keys, dates).groupBy(*keys, "date").agg(F.count_if(moved).alias("swaps"))


def forward_attribution(weights: DataFrame, prices: DataFrame, bench: DataFrame, betas: DataFrame,
                        roll_daily: float = 0.003 / 21, keys=("config_id",)) -> DataFrame:
    """Next-row portfolio return, net of itemised cost, and alpha against beta * benchmark."""
    keys = list(keys)
    fwd = prices.select("ticker", "date", (div(lead("close"), "close") - 1).alias("fwd"))
    bf = bench.select("date", (div(lead("close", 1, "index_id"), "close") - 1).alias("bench_fwd"))
    rows = weights.join(fwd, ["ticker", "date"]).join(betas.select("ticker", "beta"), "ticker", "left")
    roll = F.when(F.col("weight") < 0, -roll_daily).otherwise(0.0)
    port = rows.where(F.col("fwd").isNotNull()).groupBy(*keys, "date").agg(
        F.sum(F.col("weight") * F.col("fwd") + roll).alias("portfolio_return"),
        F.sum(F.col("weight") * F.coalesce("beta", F.lit(0.0))).alias("beta"),
        F.sum(F.abs("weight")).alias("gross"),
    )
    cost = itemised_cost(weights, keys).select(*keys, "date", "cost")
    out = port.join(cost, [*keys, "date"]).join(bf, "date")
    net = F.col("portfolio_return") - F.col("cost")
    return out.withColumn("net_return", net).withColumn("alpha", net - F.col("bench_fwd") * F.col("beta"))


def _islands(weights: DataFrame, keys: list[str], dates: DataFrame | None = None) -> DataFrame:
    """Consecutive rebalances of a name get one island number."""
    steps = rebalance_steps(weights, keys, dates)
    rn = F.row_number().over(W.partitionBy(*keys, "ticker").orderBy("date"))
    return weights.join(steps, [*keys, "date"]).withColumn("island", F.col("step") - rn)


def round_trips(weights: DataFrame, prices: DataFrame, keys=("config_id",), dates: DataFrame | None = None) -> DataFrame:
    """One row per holding spell: entry, exit (NULL and status OPEN at the end), prices, P&L."""
    keys = list(keys)
    px = prices.select("ticker", "date", "close")
    spells = _islands(weights, keys, dates).groupBy(*keys, "ticker", "island").agg(
        F.min("date").alias("entry_date"), F.max_by("next_date", "date").alias("exit_date"),
        F.max("date").alias("last_held"),
    )
    out = (
        spells.withColumn("mark_date", F.coalesce("exit_date", "last_held"))
        .join(px.select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_price")),
              ["ticker", "entry_date"], "left")
    )
    marks = asof_join(out.withColumnRenamed("mark_date", "date"),
                      px.withColumnRenamed("close", "exit_price"), ["ticker"], "date")
    return marks.select(
        *keys, "ticker", "entry_date", "exit_date",
        F.when(F.col("exit_date").isNull(), "OPEN").otherwise("CLOSED").alias("status"),
        "entry_price", "exit_price",
        ((div("exit_price", "entry_price") - 1) * 100).alias("pnl_pct"),
    )


def trade_events(weights: DataFrame, keys=("config_id",), dates: DataFrame | None = None) -> DataFrame:
    """BUY / HOLD per rebalance row and a SELL on the rebalance after a spell."""
    keys = list(keys)
    rows = _islands(weights, keys, dates)
    first = F.min("date").over(W.partitionBy(*keys, "ticker", "island"))
    final = F.max("date").over(W.partitionBy(*keys, "ticker", "island"))
    marked = rows.withColumn("_f", first).withColumn("_l", final)
    held = marked.select(
        *keys, "date", "ticker", F.when(F.col("date") == F.col("_f"), "BUY").otherwise("HOLD").alias("action")
    )
    sold = marked.where((F.col("date") == F.col("_l")) & F.col("next_date").isNotNull()).select(
        *keys, F.col("next_date").alias("date"), "ticker", F.lit("SELL").alias("action")
    )
    return held.unionByName(sold)


def holding_stats(trips: DataFrame, keys=("config_id",)) -> DataFrame:
    """Mean days of closed spells and closed spells per year."""
    closed = trips.where(F.col("status") == "CLOSED")
    years = F.datediff(F.max("exit_date"), F.min("entry_date")) / F.lit(365.25)
    return closed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg(F.datediff("exit_date", "entry_date")).alias("avg_days"),
        (F.count(F.lit(1)) / F.nullif(years, F.lit(0.0))).alias("trades_per_year"),
    )


def cash_stats(weights: DataFrame, rebalance: DataFrame, keys=("config_id",)) -> DataFrame:
    """Mean cash share and rebalances wholly in cash, counted over the rebalance calendar."""
    keys = list(keys)
    inv = weights.groupBy(*keys, "date").agg(F.sum("weight").alias("invested"))
    per = inv.groupBy(*keys).agg(
        F.sum(F.greatest(1 - F.col("invested"), F.lit(0.0))).alias("_cash"),
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("invested") == 0).alias("_zero"),
    )
    dates = rebalance.select("date").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = per.withColumn("_all", dates)
    idle = F.col("_all") - F.col("_n")
    return rows.select(
        *keys, ((F.col("_cash") + idle) / F.col("_all")).alias("cash_share"),
        (F.col("_zero") + idle).alias("cash_dates"),
    )
