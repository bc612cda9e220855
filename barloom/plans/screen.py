"""The daily momentum screen: indicators, eligibility, rank, selection, sizing, document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import rolling
from ..operators import gates as G
from ..operators import indicators as I
from ..operators import portfolio as P
from ..operators import rank as K
from ..operators import regime as R
from ..operators.joins import lookup
from ..schemas import ScreenParams
from ..sources.tables import signals_document


def screen_indicators(bars: DataFrame) -> DataFrame:
    """All windows of the screen on one exchange and one sort by (ticker, date)."""
    return (
        bars.transform(I.sma, "close", 200).transform(I.avg_turnover, 20).transform(I.avg_volume, 5)
        .transform(I.momentum).transform(I.realized_vol, 60).transform(I.ret_n, 5)
    )


def latest_rows(ind: DataFrame) -> DataFrame:
    """Last row per ticker; the window shares the exchange of the indicators."""
    last = F.row_number().over(W.partitionBy("ticker").orderBy(F.col("date").desc()))
    return ind.withColumn("_last", last).where(F.col("_last") == 1).drop("_last")


def ranked_candidates(bars: DataFrame, min_turnover: float, params: ScreenParams = ScreenParams()) -> DataFrame:
    """Eligible latest rows with regime and risk-adjusted momentum."""
    ind = G.require(latest_rows(screen_indicators(bars)), ["sma200", "mom", "vol60"])
    ok = G.eligible(I.risk_adj_momentum(ind, "screener"), min_turnover, params.min_price)
    reg = R.market_regime(R.synthetic_index(bars, R.FALLBACK_INDEX_SCALE), params.regime_sma, params.confirm_days)
    state = R.exposure_scale(reg, params.leverage, params.leverage / 2, params.reentry_streak)
    now = state.where(F.col("date") == bars.agg(F.max("date")).scalar())
    return (
        ok.withColumn("bullish", now.select("bullish").scalar())
        .withColumn("exposure", now.select("exposure").scalar())
    )


def momentum_screen(bars: DataFrame, min_turnover: float = 1e7, held: DataFrame | None = None,
                    params: ScreenParams = ScreenParams()) -> DataFrame:
    """Target rows of today: slot, ticker, weight. Outside the bull state only names above
    the momentum floor qualify and leverage is halved."""
    cand = ranked_candidates(bars, min_turnover, params)
    bull = F.coalesce("bullish", F.lit(False))
    cand = cand.where(bull | (F.col("mom") > params.bear_momentum))
    pool = K.top_n(cand.withColumn("date", F.lit(0)), "risk_adj_mom", params.top_n + params.hold_buffer)
    if held is not None:
        pool = pool.join(held.select("ticker", F.lit(True).alias("_h")), "ticker", "left")
    else:
        pool = pool.withColumn("_h", F.lit(False))
    kept = F.coalesce("_h", F.lit(False)) & (F.col("rank") <= params.hold_buffer)
    pool = pool.withColumn("kept", kept).drop("_h")
    w = W.partitionBy("date").orderBy(F.col("kept").desc(), "rank")
    n_kept = F.count_if("kept").over(W.partitionBy("date"))
    pool = pool.withColumn("slot", F.row_number().over(w)).withColumn("_k", n_kept)
    sel = pool.where(F.col("kept") | (F.col("slot") <= F.greatest(F.lit(params.top_n), F.col("_k"))))
    weights = P.cap_weights(P.momentum_weights(sel), params.position_cap, params.top_n)
    scale = F.when(bull, F.col("exposure")).otherwise(F.lit(params.leverage / 2))
    return weights.withColumn("weight", F.col("weight") * scale).select(
        "slot", "ticker", "close", "mom", "risk_adj_mom", "weight", "avg_volume5", "bullish", "kept"
    )


def screen_document(bars: DataFrame, sectors: DataFrame, min_turnover: float = 1e7,
                    held: DataFrame | None = None, capital: float = 1_000_000.0,
                    params: ScreenParams = ScreenParams()) -> DataFrame:
    """Nested signal document of the screen."""
    sel = momentum_screen(bars, min_turnover, held, params)
    sized = P.size_shares(sel.withColumnRenamed("close", "price"), capital)
    named = lookup(sized.withColumn("selected", F.lit(True)), sectors, "ticker", "sector", "General")
    held = held if held is not None else bars.select("ticker").where(F.lit(False))
    rows = P.label_orders(named, held).withColumn("hold_period", F.lit("Churn buffer"))
    rows = rows.withColumn("target_shrs", F.col("target_shrs").cast("long"))
    return signals_document(rows, {"regime": "screen", "portfolio_value": capital})
