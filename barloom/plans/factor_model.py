"""The factor model end to end: gates, betas, residuals, three signals, constraints, book."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import div
from ..functions.windows import lag
from ..operators import factors as FA
from ..operators import gates as G
from ..operators import indicators as I
from ..operators import joins as J
from ..operators import ml as L
from ..operators import positions as PO
from ..operators import rank as K
from ..schemas import FactorParams
from ..sources.scratch import cut


@dataclass(frozen=True)
class FactorInputs:
    """bars; index (index_id, date, close); sectors (ticker, sector); pairs (pair_id, leg1, leg2);
    futures-eligible names (ticker); optional fundamentals, open book and past rebalance dates.

    bars stand on every trading day from a name's first one on (`clean.fill_forward`).
    """

    bars: DataFrame
    index: DataFrame
    sectors: DataFrame
    pairs: DataFrame
    eligible: DataFrame
    fundamentals: DataFrame | None = None
    book: DataFrame | None = None
    rebalances: DataFrame | None = None


def liquid_universe(x: FactorInputs, params: FactorParams) -> DataFrame:
    """Bars of the most liquid names that pass the fundamental gate and have a close on every date of the last rows."""
    bars = x.bars
    if x.fundamentals is not None:
        bad = G.fundamental_gate(x.fundamentals).where(F.col("reason").isNotNull()).select("ticker")
        bars = J.anti(bars, bad)
    best = K.n_largest(FA.rupee_liquidity(bars), "liquidity", params.liquidity_rank)
    recent = x.bars.select("date").distinct().orderBy(F.desc("date")).limit(params.history_rows)
    whole = G.complete_history(J.semi(J.semi(bars, best.select("ticker")), recent))
    return J.semi(bars, whole.select("ticker").distinct())


def factor_signals(x: FactorInputs, params: FactorParams = FactorParams(), long_only: bool = False) -> DataFrame:
    """One row per ticker: position, z_score, signal_type, sector, effective_cost.

    Residuals, pairs and signals are written once, because every later step
    reads them several times; all are far smaller than the bars.
    """
    bars = liquid_universe(x, params)
    ret = I.log_ret(bars).select("ticker", "date", F.col("log_ret").alias("ret"))
    mkt = x.index.select("date", F.ln(div("close", lag("close", 1, "index_id"))).alias("mkt"))
    betas = cut(FA.market_beta(ret, mkt, params.lookback), "betas")
    resid = FA.residuals(ret, mkt, betas, params.lookback)
    resid = cut(FA.sector_neutral(resid, x.sectors), "residuals")

    reversion = FA.mean_reversion(FA.robust_z(resid), resid, params.z_entry)
    series = J.pair_series(bars, x.pairs, params.pair_rows, params.lookback)
    sound = FA.adf_gate(series).where("cointegrated").select("pair_id")
    spreads = FA.pair_spread(J.semi(series, sound))
    pairs = cut(FA.pair_signals(spreads, params.z_entry), "pairs")
    momentum = FA.residual_momentum(resid, params.lookback)

    sig = FA.dominant_type(FA.combine(reversion, pairs, momentum, params.weights), params.z_entry)
    sig = cut(FA.size_positions(sig, cap=params.max_position), "signals")
    sig = FA.edge_filter(FA.beta_cap(sig, betas), params.cost)
    sig = FA.restrict_shorts(FA.effective_cost(sig, params.cost, params.roll_daily), x.eligible)
    if long_only:
        sig = sig.withColumn("position", F.greatest("position", F.lit(0.0)))
    sig = cut(FA.limit_haircut(FA.sector_limit(sig, x.sectors), bars), "constrained")

    trend = G.trend_gate(bars).where(F.col("reason").isNotNull()).select("ticker")
    sector = G.sector_collapse_gate(bars, x.sectors, x.bars).where("blocked").select("ticker")
    blocked = cut(G.protect_pairs(trend.unionByName(sector), x.pairs), "blocked")
    nobody = x.eligible.where(F.lit(False)).select("ticker")
    fund = nobody
    if x.fundamentals is not None:
        fund = G.fundamental_gate(x.fundamentals).where(F.col("reason").isNotNull()).select("ticker")
    sig = G.apply_block(sig, blocked, fund, x.book if x.book is not None else nobody)
    sig = G.volume_confirm(sig, bars)
    sig = L.confidence_gate(sig, reversal_confidence(x, resid, betas, bars, params), params.min_confidence)
    return sig.join(
        pairs.select("ticker", "partner"), "ticker", "left"
    )


def reversal_confidence(x: FactorInputs, resid: DataFrame, betas: DataFrame, bars: DataFrame, params: FactorParams) -> DataFrame:
    """ticker, confidence on the latest date, by the classifier fitted at the last refit date; without rebalances it is fitted now."""
    rows = cut(L.reversal_rows(resid, betas, bars), "reversal-rows")
    live = rows.where(F.col("t") == F.col("n") - 1)
    dates = live.select("date").distinct()
    if x.rebalances is not None:
        dates = dates.unionByName(x.rebalances.select("date").join(dates.agg(F.max("date").alias("_last")), F.col("date") < F.col("_last")).select("date"))
    return L.walk_forward_confidence(rows, dates, live, params.z_entry).select("ticker", "confidence")


def step_book(x: FactorInputs, signals: DataFrame, date, params: FactorParams = FactorParams()) -> DataFrame:
    """Book after one step: exits out, survivors aged, new entries in."""
    prices = x.bars.groupBy("ticker").agg(F.max_by("close", "date").alias("price"))
    z = signals.select("ticker", F.col("z_score").alias("z_now"))
    spread = FA.pair_spread(J.pair_series(x.bars, x.pairs, params.pair_rows, params.lookback)).select("leg1", "leg2", "z")
    judged = PO.exit_reasons(x.book, prices, z, spread)
    stay = judged.where(F.col("exit_reason").isNull()).withColumn("days_held", F.col("days_held") + 1)
    cols = ["ticker", "signal_type", "direction", "entry_date", "entry_price", "entry_z", "size", "pair_partner", "days_held"]
    fresh = PO.new_entries(signals, x.book, prices, date)
    return stay.select(*cols).unionByName(fresh.select(*cols))
