"""Monthly momentum book over history: selection, weights, exposure, returns, equity, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import lead, rolling_at
from ..operators import attribution as AT
from ..operators import indicators as I
from ..operators import metrics as M
from ..operators import portfolio as P
from ..operators import rank as K
from ..operators import regime as R
from ..operators.calendar import month_end_dates
from ..schemas import ScreenParams
from ..sources.scratch import cut

PANEL = ["close", "mom", "vol60", "ret5", "sma200", "avg_turnover20", "avg_volume5", "volume"]


def month_end_panel(bars: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Every ticker's last row of each month, dated at the market's month end.

    The indicators of the screen, with their moving frames worked out on those rows only.
    dates: month, date as `month_end_dates` has them, where they come cheaper than from the bars.
    """
    month = lambda c: F.trunc(c, "month")
    df = bars.transform(I.momentum).transform(I.ret_n, 5).withColumn("_r", I.ret(1)).withColumn("_t", F.col("close") * F.col("volume"))
    df = df.withColumn("month", month("date")).withColumn("_last", ~month(lead("date")).eqNullSafe(month("date")))
    stats = {"_sd60": ("stddev_samp", "_r", 60), "sma200": ("avg", "close", 200), "avg_turnover20": ("avg", "_t", 20), "avg_volume5": ("avg", "volume", 5)}
    last = rolling_at(df, "_last", stats, ["ticker", "month", "close", "mom", "ret5", "volume"])
    last = last.withColumn("vol60", F.col("_sd60") * F.sqrt(F.lit(252.0)))
    dates = month_end_dates(bars) if dates is None else dates
    return last.join(F.broadcast(dates), "month").select("date", "ticker", *PANEL)


def monthly_book(panel: DataFrame, dates: DataFrame, regime: DataFrame | None = None, min_turnover: float = 0.0,
                 params: ScreenParams = ScreenParams()) -> DataFrame:
    """config_id, date, ticker, slot, weight; exposure is part of the weight.

    Outside the bull state the book is empty and the buffer remembers nothing.
    """
    ok = panel.where(
        (F.col("close") > F.col("sma200")) & F.col("mom").isNotNull() & (F.col("avg_turnover20") > min_turnover)
    )
    if regime is not None:
        ok = ok.join(regime.where("bullish").select("date"), "date", "left_semi")
    ranked = K.top_n(ok, "mom", params.top_n + params.hold_buffer).withColumn("config_id", F.lit(1))
    sel = P.hold_buffer(ranked, params.top_n, params.hold_buffer, dates=dates).join(
        panel.select("date", "ticker", "mom", "close"), ["date", "ticker"]
    )
    keys = ("config_id", "date")
    w = P.cap_weights(P.momentum_weights(sel, keys=keys), params.position_cap, params.top_n, keys)
    if regime is None:
        return w.withColumn("weight", F.col("weight") * params.leverage)
    return P.scale_weights(w, R.exposure_scale(regime, params.leverage, params.leverage / 2, params.reentry_streak))


def backtest(bars: DataFrame, min_turnover: float = 0.0, one_way: float = 0.0015, use_regime: bool = True,
             params: ScreenParams = ScreenParams()) -> tuple[DataFrame, DataFrame]:
    """(daily net returns and capital, one row of metrics).

    Runs from the first holding over every rebalance date: bear periods are cash,
    entered at the cost of the sale.
    """
    bars = cut(bars, "bars")
    dates = cut(month_end_dates(bars), "rebalances")
    panel = cut(month_end_panel(bars, dates), "panel")
    regime = R.market_regime(R.synthetic_index(bars), params.regime_sma, params.confirm_days) if use_regime else None
    book = cut(monthly_book(panel, dates, regime, min_turnover, params), "book")
    daily = AT.period_daily_returns(book, bars, 1.0, dates=dates, weighted=True)
    net = AT.charge_costs(daily, P.cost_drag(P.turnover(book, dates=dates), one_way))
    curve = net.select("config_id", "date", F.col("net").alias("ret"))
    curve = cut(curve, "curve")
    from ..operators.indicators import growth

    equity = growth(curve, "ret", ("config_id",), "date", "capital")
    keys = ("config_id",)
    stats = (
        M.cagr(equity, keys).join(M.ann_vol(curve, keys=keys), "config_id").join(M.sharpe(curve, keys=keys), "config_id")
        .join(M.sortino(curve, keys=keys), "config_id").join(M.max_drawdown(equity, 1.0, keys), "config_id")
    )
    return equity, stats
