"""Performance and risk metrics. Tables are keyed; `keys` may be empty for one series.

Everything that can be an aggregate is one, so it reduces before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import div, truthy
from ..functions.windows import running, series
from .indicators import drawdown

P = ("portfolio",)


def years_between(date="date"):
    return F.datediff(F.max(date), F.min(date)) / F.lit(365.25)


def safe_pow(base, exponent):
    return F.when(base > 0, F.pow(base, exponent))


def cagr(equity: DataFrame, keys=P) -> DataFrame:
    total = div(F.max_by("capital", "date"), F.min_by("capital", "date"))
    y = F.nullif(years_between(), F.lit(0.0))
    return equity.groupBy(*keys).agg((safe_pow(total, 1.0 / y) - 1).alias("cagr"))


def cagr_rows(returns: DataFrame, ann: int = 252, keys=P) -> DataFrame:
    total = F.product(1 + F.col("ret"))
    return returns.groupBy(*keys).agg((safe_pow(total, F.lit(float(ann)) / F.nullif(F.count("ret"), F.lit(0))) - 1).alias("cagr"))


def ann_vol(returns: DataFrame, ann: int = 252, keys=P) -> DataFrame:
    return returns.groupBy(*keys).agg((F.stddev_samp("ret") * F.sqrt(F.lit(float(ann)))).alias("ann_vol"))


def sharpe_of(col="ret", rf: float = 0.06, ddof: int = 1, ann: int = 252, min_rows: int = 0,
              sentinel: float | None = None):
    """Sharpe ratio as an aggregate; `sentinel` replaces it below min_rows."""
    x = F.col(col) if isinstance(col, str) else col
    sd = F.stddev_samp(x) if ddof else F.stddev_pop(x)
    value = div((F.avg(x) - rf / ann) * F.sqrt(F.lit(float(ann))), sd)
    if min_rows:
        value = F.when(F.count(x) < min_rows, F.lit(sentinel)).otherwise(value)
    return value


def sharpe(returns: DataFrame, rf: float = 0.06, ddof: int = 1, ann: int = 252, min_rows: int = 0,
           sentinel: float | None = None, keys=P) -> DataFrame:
    return returns.groupBy(*keys).agg(sharpe_of("ret", rf, ddof, ann, min_rows, sentinel).alias("sharpe"))


def sortino(returns: DataFrame, rf: float = 0.06, ann: int = 252, keys=P) -> DataFrame:
    down = F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret")))
    return returns.groupBy(*keys).agg(
        div((F.avg("ret") - rf / ann) * F.sqrt(F.lit(float(ann))), down).alias("sortino")
    )


def max_drawdown(equity: DataFrame, base: float | None = None, keys=P) -> DataFrame:
    return drawdown(equity, "capital", list(keys), "date", base).groupBy(*keys).agg(
        (F.min("drawdown") * 100).alias("max_drawdown")
    )


def max_drawdown_abs(pnl: DataFrame, keys=P, order="date") -> DataFrame:
    """Deepest fall of the cumulative P&L below its running peak, in currency."""
    cum = pnl.withColumn("_c", running(F.sum, "pnl", list(keys), order))
    dd = cum.withColumn("_d", F.col("_c") - running(F.max, "_c", list(keys), order))
    return dd.groupBy(*keys).agg(F.min("_d").alias("max_drawdown"))


def trade_stats(trades: DataFrame, pnl: str = "pnl", keys=P) -> DataFrame:
    """Win rate, mean win and loss, profit factor, expectancy."""
    p = F.col(pnl)
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    return trades.groupBy(*keys).agg(
        F.count(pnl).alias("trades"),
        (F.count_if(p > 0) / F.nullif(F.count(pnl), F.lit(0)) * 100).alias("win_rate"),
        F.avg(win).alias("avg_win"), F.avg(loss).alias("avg_loss"),
        div(F.sum(win), F.abs(F.sum(loss))).alias("profit_factor"),
        F.avg(p).alias("expectancy"),
    )


def capm(joined: DataFrame, rf: float = 0.06, ann: int = 252, keys=P) -> DataFrame:
    """Beta, annual alpha, R2, correlation and the slope's standard error on excess returns."""
    y, x = F.col("ret") - rf / ann, F.col("mkt_ret") - rf / ann
    n = F.count(F.lit(1))
    r2 = F.pow(F.corr(y, x), 2)
    err = F.sqrt((1 - r2) * F.var_samp(y) / F.nullif(F.var_samp(x), F.lit(0.0)) / F.nullif((n - 2).cast("double"), F.lit(0.0)))
    return joined.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("beta"),
        (F.regr_intercept(y, x) * ann).alias("alpha_annual"),
        r2.alias("r2"), F.corr(y, x).alias("corr"), err.alias("beta_stderr"), n.alias("n"),
    )


def capture(joined: DataFrame, keys=P) -> DataFrame:
    up, down = F.col("mkt_ret") > 0, F.col("mkt_ret") < 0
    part = lambda cond: div(F.avg(F.when(cond, F.col("ret"))), F.avg(F.when(cond, F.col("mkt_ret")))) * 100
    return joined.groupBy(*keys).agg(part(up).alias("up_capture"), part(down).alias("down_capture"))


def tracking(joined: DataFrame, ann: int = 252, keys=P) -> DataFrame:
    d = F.col("ret") - F.col("mkt_ret")
    root = F.sqrt(F.lit(float(ann)))
    return joined.groupBy(*keys).agg(
        (F.stddev_samp(d) * root).alias("tracking_error"),
        div(F.avg(d) * ann, F.stddev_samp(d) * root).alias("information_ratio"),
    )


def vol_split(joined: DataFrame, capm_table: DataFrame, ann: int = 252, keys=P) -> DataFrame:
    """Total, systematic and idiosyncratic volatility."""
    keys = list(keys)
    root = F.sqrt(F.lit(float(ann)))
    rows = joined.join(capm_table.select(*keys, "beta"), keys)
    return rows.groupBy(*keys).agg(
        (F.stddev_samp("ret") * root).alias("total_vol"),
        (F.abs(F.first("beta")) * F.stddev_samp("mkt_ret") * root).alias("systematic_vol"),
        (F.stddev_samp(F.col("ret") - F.col("beta") * F.col("mkt_ret")) * root).alias("idiosyncratic_vol"),
    )


# Borders of the R2 verdict.
R2_BORDERS = ((0.15, "pure alpha"), (0.40, "alpha dominant"), (0.65, "mixed"))
R2_TOP = "beta driven"


def r2_verdict(capm_table: DataFrame) -> DataFrame:
    verdict = F.lit(R2_TOP)
    for border, name in reversed(R2_BORDERS):
        verdict = F.when(F.col("r2") < border, name).otherwise(verdict)
    return capm_table.withColumn("verdict", verdict)


def monthly_corr(joined: DataFrame, keys=P) -> DataFrame:
    month = F.trunc("date", "month").alias("month")
    per = joined.groupBy(*keys, month).agg(
        (F.product(1 + F.col("ret")) - 1).alias("a"), (F.product(1 + F.col("mkt_ret")) - 1).alias("b")
    )
    return per.groupBy(*keys).agg(F.corr("a", "b").alias("monthly_corr"), F.count(F.lit(1)).alias("months"))


def annual_table(equity: DataFrame, keys=P) -> DataFrame:
    """Return and deepest fall inside each year."""
    keys = list(keys)
    rows = equity.withColumn("year", F.year("date"))
    dd = drawdown(rows, "capital", [*keys, "year"])
    return dd.groupBy(*keys, "year").agg(
        (div(F.max_by("capital", "date"), F.min_by("capital", "date")) - 1).alias("ret"),
        F.min("drawdown").alias("max_drawdown"),
    )


def weekly_summary(results: DataFrame, ann: int = 52, keys=P) -> DataFrame:
    """Summary of a periodic strategy: net and benchmark returns, alpha, cost, turnover."""
    keys = list(keys)
    root = F.sqrt(F.lit(float(ann)))
    rows = results.withColumn("_g", running(F.product, 1 + F.col("net_return"), keys))
    rows = rows.withColumn("_dd", F.col("_g") / running(F.max, "_g", keys) - 1)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"),
        (F.product(1 + F.col("net_return")) - 1).alias("total_return"),
        (F.avg("net_return") * ann).alias("annual_return"),
        (F.stddev_samp("net_return") * root).alias("annual_vol"),
        sharpe_of("net_return", 0.0, 1, ann).alias("sharpe"),
        (F.avg("alpha") * ann).alias("annual_alpha"),
        div(F.avg("alpha") * root, F.stddev_samp("alpha")).alias("information_ratio"),
        F.regr_slope("net_return", "bench_fwd").alias("beta"),
        F.min("_dd").alias("max_drawdown"),
        (F.count_if(F.col("net_return") > 0) / F.count(F.lit(1))).alias("hit_rate"),
        F.avg("cost").alias("avg_cost"), F.avg("gross").alias("avg_gross"),
        (F.product(1 + F.col("bench_fwd")) - 1).alias("benchmark_total"),
    )


def relative_growth(joined: DataFrame, keys=P) -> DataFrame:
    keys = list(keys)
    g = running(F.product, 1 + F.col("ret"), keys)
    m = running(F.product, 1 + F.col("mkt_ret"), keys)
    return joined.withColumn("relative", div(g, m))


def compare_scenarios(summaries: dict[str, DataFrame], metrics: list[str], keys=P) -> DataFrame:
    """Scenario summaries side by side: metric, then one column per scenario."""
    out = None
    for name, df in summaries.items():
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
        part = df.select(*keys, F.lit(name).alias("scenario"), F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys, "metric").pivot("scenario", list(summaries)).agg(F.first("v"))


def segment_metrics(returns: DataFrame, split, keys=P, ann: int = 252) -> DataFrame:
    """Metrics before and from the split date."""
    keys = list(keys)
    rows = returns.withColumn(
        "segment", F.when(F.col("date") < F.lit(split).cast("date"), "train").otherwise("test")
    )
    g = rows.withColumn("_g", running(F.product, 1 + F.col("ret"), [*keys, "segment"]))
    g = g.withColumn("_dd", F.col("_g") / running(F.max, "_g", [*keys, "segment"]) - 1)
    return g.groupBy(*keys, "segment").agg(
        (F.product(1 + F.col("ret")) - 1).alias("total_return"),
        (safe_pow(F.product(1 + F.col("ret")), F.lit(float(ann)) / F.nullif(F.count("ret"), F.lit(0))) - 1).alias("cagr"),
        sharpe_of("ret", 0.0, 0, ann).alias("sharpe"), F.min("_dd").alias("max_drawdown"),
        F.count(F.lit(1)).alias("rows"),
    )


split_metrics = segment_metrics


def oos_degradation(returns: DataFrame, split, keys=P, ann: int = 252) -> DataFrame:
    """Out-of-sample Sharpe as a share of in-sample Sharpe."""
    seg = segment_metrics(returns, split, keys, ann)
    pick = lambda s, c: F.max(F.when(F.col("segment") == s, F.col(c)))
    return seg.groupBy(*keys).agg(
        pick("train", "sharpe").alias("is_sharpe"), pick("test", "sharpe").alias("oos_sharpe"),
        div(pick("test", "sharpe"), pick("train", "sharpe")).alias("sharpe_kept"),
        (pick("test", "cagr") - pick("train", "cagr")).alias("cagr_change"),
    )
