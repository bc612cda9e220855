"""Metrics of paths, stress tests and parameter sweeps, spread over configurations.

Resampled paths come from `resampling`. Rows are reduced before configurations
multiply them; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import div, finite, truthy
from ..functions.windows import lag, lead, rolling_at, running
from ..sources.scratch import cut
from .attribution import charge_costs, period_daily_returns
from .calendar import month_end_dates
from .joins import cross_configs
from .metrics import safe_pow, sharpe_of
from .portfolio import cost_drag, hold_buffer, turnover
from .rank import best_config, top_n
from .regime import market_regime, synthetic_index

P = "portfolio"
SIM = (P, "sim")

# Fixed value: cost of buying and selling again.
ROUND_TRIP_COST = 0.0035


def path_metrics(paths: DataFrame, ann: int = 252, keys=SIM) -> DataFrame:
    """CAGR, deepest fall and Sharpe of every path."""
    keys = list(keys)
    g = paths.withColumn("_g", running(F.product, 1 + F.col("ret"), keys, "pos"))
    g = g.withColumn("_dd", F.col("_g") / running(F.max, "_g", keys, "pos") - 1)
    final = F.max_by("_g", "pos")
    return g.groupBy(*keys).agg(
        final.alias("final"),
        F.coalesce(safe_pow(final, F.lit(float(ann)) / F.count(F.lit(1))) - 1, F.lit(-1.0)).alias("cagr"),
        F.min("_dd").alias("max_drawdown"), sharpe_of("ret", 0.0, 1, ann).alias("sharpe"),
    )


def path_summary(metrics: DataFrame, ruin: float = -0.50, min_cagr: float = 0.0, max_loss_prob: float = 0.5, keys=(P,)) -> DataFrame:
    """Distribution over the simulations of each portfolio (n_sim values per group)."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sims"), q("cagr", 0.5).alias("cagr_median"), q("cagr", 0.05).alias("cagr_p05"),
        F.min("cagr").alias("cagr_worst"), q("max_drawdown", 0.5).alias("dd_median"), q("max_drawdown", 0.05).alias("dd_p05"),
        F.avg((F.col("max_drawdown") <= ruin).cast("double")).alias("ruin_prob"),
        F.avg((F.col("final") < 1).cast("double")).alias("loss_prob"),
    ).withColumn("passed", (F.col("cagr_median") > min_cagr) & (F.col("loss_prob") <= max_loss_prob))


# ---- configurations

def sweep_panel(bars: DataFrame, grid: list[dict]) -> DataFrame:
    """Month-end cross-sections with what any configuration asks for: close, trend, turnover,
    volatility, one momentum column per (window, skip), one state column per regime window.

    Moving frames are worked out on the month ends only, and rows are reduced to months x tickers
    before any configuration multiplies them. Written once.
    """
    month = lambda c: F.trunc(c, "month")
    ret = F.coalesce(div("close", lag("close")) - 1, F.lit(0.0))
    ind = bars.withColumn("_r", ret).withColumn("_t", F.col("close") * F.col("volume"))
    ind = ind.withColumn("month", month("date")).withColumn("_last", ~month(lead("date")).eqNullSafe(month("date")))
    pairs = grid_pairs(grid)
    for window, skip in pairs:
        recent = lag("close", skip) if skip else F.col("close")
        ind = ind.withColumn(f"mom_{window}_{skip}", div(recent, lag("close", window)) - 1)
    stats = {"sma200": ("avg", "close", 200), "avg_turnover20": ("avg", "_t", 20), "_sd60": ("stddev_samp", "_r", 60)}
    last = rolling_at(ind, "_last", stats, ["ticker", "month", "close", *[f"mom_{w}_{s}" for w, s in pairs]])
    last = last.withColumn("vol60", F.coalesce(F.col("_sd60") * F.sqrt(F.lit(252.0)), F.lit(0.3)))
    cols = ["close", "sma200", "avg_turnover20", "vol60", *[f"mom_{w}_{s}" for w, s in pairs]]
    panel = last.join(F.broadcast(month_end_dates(bars)), "month").select("date", "ticker", *cols)
    index = cut(synthetic_index(bars), "index")
    for n in sorted({c["regime_sma"] for c in grid}):
        state = market_regime(index, n).select("date", F.col("bullish").alias(f"bull_{n}"))
        panel = panel.join(state, "date", "left")
    return cut(panel, "sweep-panel")


def grid_pairs(grid: list[dict]) -> list[tuple[int, int]]:
    return sorted({(c["window"], c["skip"]) for c in grid})


def config_returns(panel: DataFrame, bars: DataFrame, grid: list[dict], dates: DataFrame, extra_keys: tuple[str, ...] = (),
                   min_price: float = 10.0) -> DataFrame:
    """config_id, date, ret: daily net return of each configuration's book.

    grid: config_id, window, skip, top_n, hold_rank (0: none), regime_sma, min_turnover,
    leverage. In a bull state the book holds the best names by risk-adjusted momentum
    among those above their trend, the turnover floor and the price floor, in equal
    parts; else it is cash. Costs are one way on the weights moved. The extra keys
    restart the holdings (for example per year); dates then has them too.
    """
    keys = ["config_id", "top_n", "hold_rank", "leverage", *extra_keys]
    mom, bull = F.lit(None).cast("double"), F.lit(False)
    for w, s in grid_pairs(grid):
        mom = F.when((F.col("window") == w) & (F.col("skip") == s), F.col(f"mom_{w}_{s}")).otherwise(mom)
    for n in sorted({c["regime_sma"] for c in grid}):
        bull = F.when(F.col("regime_sma") == n, truthy(f"bull_{n}")).otherwise(bull)
    score = F.coalesce(finite(F.col("_mom") / (F.col("vol60") + 1e-6)), F.col("_mom"))
    cand = cross_configs(panel, grid).where(
        bull & (F.col("close") > F.col("sma200")) & (F.col("avg_turnover20") > F.col("min_turnover")) & (F.col("close") > min_price)
    ).withColumn("_mom", mom).where(F.col("_mom").isNotNull()).withColumn("score", score)
    depth = max(c["top_n"] + c["hold_rank"] for c in grid)
    ranked = top_n(cand, "score", depth, ("config_id", "date")).where(F.col("rank") <= F.col("top_n") + F.col("hold_rank"))
    book = hold_buffer(cut(ranked.select(*keys, "date", "ticker", "rank"), "ranked"), F.col("top_n"), F.col("hold_rank"), keys, depth, dates)
    size = F.count(F.lit(1)).over(W.partitionBy(*keys, "date"))
    book = cut(book.withColumn("weight", F.col("leverage") / size), "sweep-book")
    daily = period_daily_returns(book, bars, 1.0, keys, dates, weighted=True)
    net = charge_costs(daily, cost_drag(turnover(book, keys, dates), ROUND_TRIP_COST / 2), keys)
    return cut(net.select("config_id", *extra_keys, "date", F.col("net").alias("ret")), "sweep-returns")


def config_metrics(returns: DataFrame, keys=("config_id",), ann: int = 252) -> DataFrame:
    return path_metrics(returns.withColumnRenamed("date", "pos"), ann, keys)


def one_at_a_time(metrics: DataFrame, baseline: int = 0) -> DataFrame:
    """Change of CAGR against the baseline configuration."""
    base = metrics.where(F.col("config_id") == baseline).select("cagr").scalar()
    return metrics.withColumn("delta_cagr", F.col("cagr") - base)


def grid_2d(metrics: DataFrame, grid: list[dict], rows: str, cols: str, metric: str = "sharpe") -> DataFrame:
    lookup = lambda k: F.element_at(F.create_map(*[x for c in grid for x in (F.lit(c["config_id"]), F.lit(c[k]))]), F.col("config_id"))
    values = sorted({c[cols] for c in grid})
    labelled = metrics.withColumn(rows, lookup(rows)).withColumn(cols, lookup(cols))
    return labelled.groupBy(rows).pivot(cols, values).agg(F.first(metric))


def blind_test(returns: DataFrame, split) -> DataFrame:
    """Best Sharpe before the split, its metrics from the split on."""
    day = F.lit(split).cast("date")
    train = config_metrics(returns.where(F.col("date") < day))
    test = config_metrics(returns.where(F.col("date") >= day))
    best = best_config(train, "sharpe").select("config_id", F.col("sharpe").alias("train_sharpe"))
    return best.join(test, "config_id")


def walk_forward(returns: DataFrame, train_years: int = 5) -> DataFrame:
    """year, config_id, train_sharpe, ret, days: each year runs the configuration with the best
    Sharpe of the train_years years before; years without as many are left out.

    A day counts for the next `train_years` years: it is spread over them
    (at most train_years copies of a config-day row) and aggregated once.
    """
    yr = returns.withColumn("y", F.year("date"))
    first = returns.agg(F.min(F.year("date")).alias("m")).scalar()
    last = returns.agg(F.max(F.year("date")).alias("m")).scalar()
    train = yr.select("config_id", "ret", F.explode(F.sequence(F.col("y") + 1, F.col("y") + train_years)).alias("year"))
    train = train.where((F.col("year") <= last) & (F.col("year") >= first + train_years))
    score = train.groupBy("year", "config_id").agg(sharpe_of("ret", 0.0, 1, 252).alias("train_sharpe"))
    best = best_config(score.where(F.col("train_sharpe").isNotNull()), "train_sharpe", ("year",))
    year = yr.groupBy(F.col("y").alias("year"), "config_id").agg((F.product(1 + F.col("ret")) - 1).alias("ret"), F.count(F.lit(1)).alias("days"))
    return best.join(year, ["year", "config_id"])


def isolated_years(panel: DataFrame, bars: DataFrame, grid: list[dict], dates: DataFrame) -> DataFrame:
    """Each year on its own: holdings empty at its start, the last rebalance of the year its end."""
    year = lambda df: df.withColumn("year", F.year("date"))
    return config_metrics(config_returns(year(panel), bars, grid, year(dates), ("year",)), ("config_id", "year"))


def ab_variants(metrics: DataFrame, baseline: int = 0) -> DataFrame:
    """Variants that beat the baseline on both Sharpe and drawdown; equal to nine places is no win."""
    base = metrics.where(F.col("config_id") == baseline).select(F.struct("sharpe", "max_drawdown").alias("b")).scalar()
    return metrics.where(F.col("config_id") != baseline).withColumn("_b", base).withColumn(
        "wins", (F.round("sharpe", 9) > F.round("_b.sharpe", 9)) & (F.round("max_drawdown", 9) > F.round("_b.max_drawdown", 9))
    ).drop("_b")


def share_profitable(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count(F.lit(1)).alias("configs"), F.count_if(F.col("cagr") > 0).alias("profitable"),
        F.avg((F.col("cagr") > 0).cast("double")).alias("share"),
    )
