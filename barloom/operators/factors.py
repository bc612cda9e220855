"""Cross-sectional factor operators: betas, residuals, z-scores, pairs, constraints.

A signals table has one row per ticker: ticker, position, z_score, signal_type, ...
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clip, div, truthy
from ..functions.orderstats import pct_rank, quantiles
from ..functions.windows import keep_last, rolling, with_group_stats, with_totals
from .aggregates import median_mad

# Scale of the median absolute deviation, critical value of the residual
# unit-root test at 5 %, default lot size.
MAD_SCALE = 1.4826
COINT_5PCT = -3.34
DEFAULT_LOT = 500


def _recent(df: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    rn = F.row_number().over(W.partitionBy(key).orderBy(F.col("date").desc()))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= n)


def market_beta(returns: DataFrame, market: DataFrame, n: int = 252) -> DataFrame:
    """alpha, beta, r2 and residual deviation over the last n rows, in one pass.

    Residuals of a regression with intercept average zero, so their sample
    variance is (1 - r2) times the variance of y.
    """
    rows = _recent(returns.join(market, "date").dropna(subset=["ret", "mkt"]), n)
    y, x = F.col("ret"), F.col("mkt")
    r2 = F.regr_r2(y, x)
    return rows.groupBy("ticker").agg(
        F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"), r2.alias("r2"),
        F.sqrt(F.greatest(1 - r2, F.lit(0.0)) * F.var_samp(y)).alias("resid_vol"),
        F.count(F.lit(1)).alias("n"),
    )


def residuals(returns: DataFrame, market: DataFrame, betas: DataFrame, n: int = 252) -> DataFrame:
    """ticker, date, resid over the same last n rows."""
    rows = _recent(returns.join(market, "date").dropna(subset=["ret", "mkt"]), n)
    return rows.join(betas.select("ticker", "alpha", "beta"), "ticker").select(
        "ticker", "date", (F.col("ret") - F.col("alpha") - F.col("beta") * F.col("mkt")).alias("resid")
    )


def sector_neutral(resid: DataFrame, sector_map: DataFrame, min_members: int = 3, default: str = "Other") -> DataFrame:
    """Subtract the sector mean of the date in sectors with enough members."""
    rows = resid.join(sector_map.select("ticker", "sector"), "ticker", "left").withColumn(
        "sector", F.coalesce("sector", F.lit(default))
    )
    members = rows.groupBy("sector").agg(F.countDistinct("ticker").alias("_members"))
    means = rows.groupBy("date", "sector").agg(F.avg("resid").alias("_m"))
    out = rows.join(members, "sector").join(means, ["date", "sector"])
    return out.withColumn(
        "resid", F.when(F.col("_members") >= min_members, F.col("resid") - F.col("_m")).otherwise(F.col("resid"))
    ).select("ticker", "date", "sector", "resid")


def robust_z(resid: DataFrame, n: int = 5) -> DataFrame:
    """Last n residuals summed, then (x - median) / (1.4826 * MAD) across tickers."""
    form = _recent(resid, n).groupBy("ticker").agg(F.sum("resid").alias("formation"))
    mm = median_mad(form, [], "formation")
    both = mm.select(F.struct("median", "mad").alias("t")).scalar()
    return form.withColumn("_t", both).select(
        "ticker", "formation",
        div(F.col("formation") - F.col("_t.median"), MAD_SCALE * F.col("_t.mad")).alias("z_score"),
    )


def mean_reversion(z: DataFrame, resid: DataFrame, z_entry: float = 2.0) -> DataFrame:
    """Short the stretched, buy the depressed, scaled by inverse annual residual vol (mean scale 1)."""
    vol = resid.groupBy("ticker").agg(
        F.nullif(F.stddev_samp("resid") * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("vol")
    ).select("ticker", (1.0 / F.col("vol")).alias("inv"))
    mid = quantiles(vol, [], "inv", {"m": 0.5}).scalar()
    rows = z.join(vol, "ticker", "left").withColumn("inv", F.coalesce("inv", mid))
    rows = with_totals(rows, _s=F.sum("inv"), _n=F.count(F.lit(1)))
    raw = F.when(F.col("z_score") > z_entry, -1).when(F.col("z_score") < -z_entry, 1).otherwise(0)
    return rows.select(
        "ticker", "z_score", raw.alias("raw_alpha"),
        (raw * F.col("inv") / F.col("_s") * F.col("_n")).alias("alpha_signal"),
    )


def residual_momentum(resid: DataFrame, start: int = 252, end: int = 22) -> DataFrame:
    """Sum of residual rows end..start back, percentile rank, decile signal and z = (rank - 0.5) * 4."""
    rows = _recent(resid, start).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col("_rn") >= end, F.col("resid"))).alias("cum")
    ).where(F.col("_n") >= start).select("ticker", "cum")
    r = pct_rank(rows, "cum", ())
    signal = F.when(F.col("pct_rank") > 0.9, 1).when(F.col("pct_rank") < 0.1, -1).otherwise(0)
    return r.select("ticker", "cum", "pct_rank", signal.alias("alpha_signal"), ((F.col("pct_rank") - 0.5) * 4).alias("z_score"))


def pair_spread(pairs: DataFrame) -> DataFrame:
    """Hedge ratio and z of the last spread, in one aggregate.

    Mean and variance of p1 - h * p2 follow from the moments of both legs.
    """
    h = F.col("hedge_ratio")
    m = pairs.groupBy("pair_id", "leg1", "leg2").agg(
        F.regr_slope("p1", "p2").alias("hedge_ratio"), F.avg("p1").alias("_m1"), F.avg("p2").alias("_m2"),
        F.var_samp("p1").alias("_v1"), F.var_samp("p2").alias("_v2"), F.covar_samp("p1", "p2").alias("_c"),
        F.max_by("p1", "date").alias("_l1"), F.max_by("p2", "date").alias("_l2"), F.count(F.lit(1)).alias("n"),
    )
    std = F.sqrt(F.greatest(F.col("_v1") + h * h * F.col("_v2") - 2 * h * F.col("_c"), F.lit(0.0)))
    last, mean = F.col("_l1") - h * F.col("_l2"), F.col("_m1") - h * F.col("_m2")
    return m.select("pair_id", "leg1", "leg2", "hedge_ratio", std.alias("spread_std"),
                    div(last - mean, std).alias("z"), "n")


def adf_gate(pairs: DataFrame, lags: int = 1, crit: float = COINT_5PCT) -> DataFrame:
    """Residual unit-root test per pair with a fixed number of lags (0 or 1).

    Regress the change of the residual on its level and, with lags = 1, on the
    change before; compare the level's t value with the 5 % critical value. The
    fit is solved from sums of squares, one aggregate per pair.
    """
    if lags not in (0, 1):
        raise ValueError("lags must be 0 or 1")
    fit = pairs.groupBy("pair_id").agg(
        F.regr_slope("p1", "p2").alias("h"), F.regr_intercept("p1", "p2").alias("a")
    )
    w = W.partitionBy("pair_id").orderBy("date")
    e = pairs.join(fit, "pair_id").withColumn("e", F.col("p1") - F.col("a") - F.col("h") * F.col("p2"))
    e = e.withColumn("e1", F.lag("e").over(w)).withColumn("d", F.col("e") - F.col("e1"))
    e = e.withColumn("d1", F.lag("d").over(w))
    if lags == 0:
        e = e.withColumn("d1", F.when(F.col("d").isNotNull(), 0.0))
    e = e.where(F.col("d1").isNotNull() & F.col("d").isNotNull())
    s = e.groupBy("pair_id", "leg1", "leg2").agg(
        F.sum(F.col("e1") * F.col("e1")).alias("s11"), F.sum(F.col("e1") * F.col("d1")).alias("s12"),
        F.sum(F.col("d1") * F.col("d1")).alias("s22"), F.sum(F.col("e1") * F.col("d")).alias("b1"),
        F.sum(F.col("d1") * F.col("d")).alias("b2"), F.sum(F.col("d") * F.col("d")).alias("yy"),
        F.count(F.lit(1)).alias("n"),
    )
    if lags == 0:
        s = s.withColumn("s22", F.lit(1.0)).withColumn("s12", F.lit(0.0)).withColumn("b2", F.lit(0.0))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    g = (F.col("b1") * F.col("s22") - F.col("b2") * F.col("s12")) / F.nullif(det, F.lit(0.0))
    c = (F.col("b2") * F.col("s11") - F.col("b1") * F.col("s12")) / F.nullif(det, F.lit(0.0))
    sse = F.col("yy") - g * F.col("b1") - c * F.col("b2")
    se = F.sqrt(sse / F.nullif((F.col("n") - 1 - lags).cast("double"), F.lit(0.0)) * F.col("s22") / F.nullif(det, F.lit(0.0)))
    return s.select("pair_id", "leg1", "leg2", div(g, se).alias("t_stat")).withColumn(
        "cointegrated", truthy(F.col("t_stat") < crit)
    )


def pair_signals(spreads: DataFrame, z_entry: float = 2.0) -> DataFrame:
    """Two legs per stretched pair; a ticker in several pairs keeps the last one."""
    size = F.least(F.abs("z") / 3.0, F.lit(1.0))
    direction = -F.signum("z")
    long_first = F.col("z") < 0
    legs = F.array(
        F.struct(
            F.col("leg1").alias("ticker"), F.col("leg2").alias("partner"), (direction * size).alias("alpha_signal"),
            F.col("z").alias("z_score"), F.col("hedge_ratio").alias("hedge_ratio"),
            F.when(long_first, "pairs_long").otherwise("pairs_short").alias("signal_type"),
        ),
        F.struct(
            F.col("leg2").alias("ticker"), F.col("leg1").alias("partner"),
            (-direction * size * F.col("hedge_ratio")).alias("alpha_signal"), (-F.col("z")).alias("z_score"),
            F.coalesce(div(F.lit(1.0), "hedge_ratio"), F.lit(0.0)).alias("hedge_ratio"),
            F.when(long_first, "pairs_short").otherwise("pairs_long").alias("signal_type"),
        ),
    )
    rows = spreads.where(F.abs("z") > z_entry).select("pair_id", F.inline(legs))
    return keep_last(rows, ["ticker"], ["pair_id"])


def combine(cs: DataFrame, pairs: DataFrame, mom: DataFrame, weights=(0.40, 0.35, 0.25)) -> DataFrame:
    """Demean the three signals across tickers and blend them; the z is the largest magnitude."""
    pick = lambda df, s: df.select("ticker", F.col("alpha_signal").alias(f"{s}_a"), F.col("z_score").alias(f"{s}_z"))
    j = (
        pick(cs, "cs")
        .join(pick(pairs, "pairs").join(pairs.select("ticker", F.col("signal_type").alias("pair_type")), "ticker"), "ticker", "left")
        .join(pick(mom, "mom"), "ticker", "left")
    )
    nums = [f"{s}_{k}" for s in ("cs", "pairs", "mom") for k in ("a", "z")]
    j = j.fillna(0.0, nums)
    j = with_totals(j, _c=F.avg("cs_a"), _p=F.avg("pairs_a"), _m=F.avg("mom_a"))
    blend = (weights[0] * (F.col("cs_a") - F.col("_c")) + weights[1] * (F.col("pairs_a") - F.col("_p"))
             + weights[2] * (F.col("mom_a") - F.col("_m")))
    return j.select(
        "ticker", blend.alias("alpha_signal"), "cs_z", "pairs_z", "mom_z", "pair_type",
        F.greatest(F.abs("cs_z"), F.abs("pairs_z"), F.abs("mom_z")).alias("z_score"),
    )


def dominant_type(combined: DataFrame, z_entry: float = 2.0, mom_z: float = 1.5) -> DataFrame:
    return combined.withColumn(
        "signal_type",
        F.when(F.abs("pairs_z") > z_entry, F.col("pair_type")).when(F.abs("mom_z") > mom_z, "residual_momentum")
        .otherwise("mean_reversion"),
    )


def size_positions(combined: DataFrame, gross: float = 2.0, cap: float = 0.03) -> DataFrame:
    """Scale to the gross target and clip each position."""
    t = with_totals(combined, _g=F.sum(F.abs("alpha_signal")))
    raw = F.when(F.col("_g") > 0, F.col("alpha_signal") / F.nullif("_g", F.lit(0.0)) * gross).otherwise(0.0)
    return t.withColumn("position", clip(raw, -cap, cap)).drop("_g")


def beta_cap(signals: DataFrame, betas: DataFrame, limit: float = 0.05, target: float = 0.04) -> DataFrame:
    """Scale the book when its beta is beyond the limit."""
    j = signals.join(betas.select("ticker", F.col("beta").alias("_b")), "ticker", "left")
    j = with_totals(j, beta_exposure=F.sum(F.col("position") * F.coalesce("_b", F.lit(0.0))))
    scale = F.when(F.abs("beta_exposure") > limit, target / F.nullif(F.abs("beta_exposure"), F.lit(0.0))).otherwise(1.0)
    return j.withColumn("_s", scale).withColumn("position", F.col("position") * F.col("_s")).withColumn(
        "beta_exposure", F.col("beta_exposure") * F.col("_s")
    ).drop("_s", "_b")


def edge_filter(signals: DataFrame, cost: float = 0.0010) -> DataFrame:
    ok = truthy(F.abs("z_score") * 0.02 > 4 * cost)
    return signals.withColumn("position", F.when(ok, F.col("position")).otherwise(0.0))


def restrict_shorts(signals: DataFrame, eligible: DataFrame) -> DataFrame:
    """Shorts need a futures contract."""
    j = signals.join(eligible.select("ticker").distinct().withColumn("_e", F.lit(True)), "ticker", "left")
    bad = (F.col("position") < -0.001) & ~truthy("_e")
    return j.withColumn("position", F.when(bad, 0.0).otherwise(F.col("position"))).drop("_e")


def sector_limit(signals: DataFrame, sector_map: DataFrame, limit: float = 0.25, default: str = "Other") -> DataFrame:
    """Scale a sector whose net exposure is beyond the limit."""
    j = signals.join(sector_map.select("ticker", "sector"), "ticker", "left").withColumn(
        "sector", F.coalesce("sector", F.lit(default))
    )
    j = with_group_stats(j, ["sector"], _net=F.sum("position"))
    scale = F.when(F.abs("_net") > limit, limit / F.nullif(F.abs("_net"), F.lit(0.0))).otherwise(1.0)
    return j.withColumn("position", F.col("position") * scale).drop("_net")


def limit_haircut(signals: DataFrame, bars: DataFrame, days: int = 5, limit: float = 0.09) -> DataFrame:
    """Halve and tag names that moved beyond the limit within the last closes."""
    w = W.partitionBy("ticker").orderBy(F.col("date").desc())
    rows = bars.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_r", F.abs(div("close", F.lead("close").over(w)) - 1)
    )
    hot = rows.where(F.col("_rn") <= days - 1).groupBy("ticker").agg(F.max("_r").alias("_max"))
    j = signals.join(hot, "ticker", "left").withColumn("_hit", truthy(F.col("_max") > limit))
    return (
        j.withColumn("position", F.when(F.col("_hit"), F.col("position") * 0.5).otherwise(F.col("position")))
        .withColumn("signal_type", F.when(F.col("_hit"), F.concat("signal_type", F.lit("_circuit_warning"))).otherwise(F.col("signal_type")))
        .drop("_max", "_hit")
    )


def effective_cost(signals: DataFrame, cost: float = 0.0010, roll: float = 0.003 / 21) -> DataFrame:
    return signals.withColumn(
        "effective_cost", F.when(F.col("position") < 0, F.lit(cost + roll)).otherwise(F.lit(cost))
    )


def vol_liquidity(bars: DataFrame, n: int = 20) -> DataFrame:
    """Price times whole-history return deviation, averaged over the last n rows."""
    ret = div("close", F.lag("close").over(W.partitionBy("ticker").orderBy("date"))) - 1
    rows = bars.withColumn("_r", ret)
    sd = rows.groupBy("ticker").agg(F.stddev_samp("_r").alias("_sd"))
    last = _recent(bars, n).groupBy("ticker").agg(F.avg("close").alias("_c"), F.count(F.lit(1)).alias("_n"))
    return last.join(sd, "ticker").select("ticker", F.when(F.col("_n") == n, F.col("_c") * F.col("_sd")).alias("liquidity"))


def rupee_liquidity(bars: DataFrame, n: int = 20, as_of=None) -> DataFrame:
    """Mean traded value over the last n rows up to the date."""
    if as_of is not None:
        bars = bars.where(F.col("date") <= F.lit(as_of).cast("date"))
    last = _recent(bars, n).groupBy("ticker").agg(
        F.avg(F.col("close") * F.col("volume")).alias("_l"), F.count(F.lit(1)).alias("_n")
    )
    return last.select("ticker", F.when(F.col("_n") == n, F.col("_l")).alias("liquidity"))


def lot_table(signals: DataFrame, lots: DataFrame, nav: float, default: int = DEFAULT_LOT) -> DataFrame:
    """Notional and lot size of every active position."""
    j = signals.where(F.abs("position") > 0.001).join(lots.select("ticker", "lot_size"), "ticker", "left")
    return j.select(
        "ticker", F.round("position", 4).alias("position_fraction"),
        F.round(F.abs("position") * nav, 0).alias("notional"),
        F.coalesce("lot_size", F.lit(default)).alias("lot_size"),
        F.when(F.col("position") > 0, "LONG").otherwise("SHORT FUTURES").alias("direction"), "signal_type",
    )
