"""Open-interest states and option spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col_of, div, truthy
from ..functions.windows import lag, rolling, series
from ..sources.scratch import cut
from .joins import alike, range_join, two_legs

# Strike steps by price band.
STRIKE_BANDS = ((10000, 100), (1000, 50), (500, 10))
STRIKE_MIN_STEP = 5
# Thresholds of the open-interest states and their index variants.
OI_SPIKE, PRICE_MOVE = 0.05, 0.005
INDEX_OI_SPIKE, INDEX_PRICE_MOVE = 0.00, 0.001
# Strike distance of index spreads and of all others.
INDEX_WIDTHS = {"NIFTY": 150.0, "BANKNIFTY": 300.0}
UP_STRIKE, DOWN_STRIKE = 1.03, 0.97
TAKE_PROFIT = 0.50
# State, action and note texts.
LONG_BUILDUP, SHORT_BUILDUP = "Long Buildup", "Short Buildup"
SHORT_COVERING, LONG_UNWINDING, NEUTRAL = "Short Covering", "Long Unwinding", "Neutral"
BULL_CALL, BEAR_PUT = "Bull Call Spread", "Bear Put Spread"
EARLY_EXIT, EXPIRY_EXIT = "50% Profit Exit", "Expiry"
# Index names of the tag, tried in this order.
INDEX_TAGS = ("BANKNIFTY", "FINNIFTY", "MIDCPNIFTY", "NIFTY")


def strike_step(price):
    p = col_of(price)
    step = F.lit(STRIKE_MIN_STEP)
    for above, s in reversed(STRIKE_BANDS):
        step = F.when(p > above, s).otherwise(step)
    return step


def round_strike(price):
    """Nearest strike, ties to the even multiple."""
    return F.bround(col_of(price) / strike_step(price)) * strike_step(price)


def oi_baseline(fut: DataFrame, n: int = 5, min_periods: int = 3) -> DataFrame:
    """Mean open interest of the n rows before."""
    w = series("symbol").rowsBetween(-n, -1)
    return fut.withColumn(
        "oi_base", F.when(F.count("open_int").over(w) >= min_periods, F.avg("open_int").over(w))
    )


def oi_changes(fut: DataFrame) -> DataFrame:
    prev = lag("close", 1, "symbol")
    return fut.withColumn("oi_chg", div(F.col("open_int") - F.col("oi_base"), "oi_base")).withColumn(
        "px_chg", div(F.col("close") - prev, prev)
    )


def dynamic_thresholds(fut: DataFrame, index_names: tuple[str, ...], oi: float = OI_SPIKE,
                       px: float = PRICE_MOVE) -> DataFrame:
    is_index = F.col("symbol").isin(*index_names)
    return fut.withColumn("oi_thr", F.when(is_index, INDEX_OI_SPIKE).otherwise(oi)).withColumn(
        "px_thr", F.when(is_index, INDEX_PRICE_MOVE).otherwise(px)
    )


def oi_state(fut: DataFrame) -> DataFrame:
    up_oi, down_oi = F.col("oi_chg") > F.col("oi_thr"), F.col("oi_chg") < -F.col("oi_thr")
    up_px, down_px = F.col("px_chg") >= F.col("px_thr"), F.col("px_chg") <= -F.col("px_thr")
    return fut.withColumn(
        "state",
        F.when(up_oi & up_px, LONG_BUILDUP).when(up_oi & down_px, SHORT_BUILDUP)
        .when(down_oi & up_px, SHORT_COVERING).when(down_oi & down_px, LONG_UNWINDING)
        .otherwise(NEUTRAL),
    )


def confirm_n(fut: DataFrame, n: int = 3) -> DataFrame:
    """The same state, not Neutral, on n rows in a row."""
    same = F.col("state") != NEUTRAL
    for i in range(1, n):
        same = same & truthy(F.col("state") == lag("state", i, "symbol"))
    return fut.withColumn("confirmed", same)


def regime_mask(setups: DataFrame, regime: DataFrame) -> DataFrame:
    """Stock setups only while the market is bullish; index contracts always."""
    j = setups.join(regime.select("date", "bullish"), "date", "left")
    return j.where((F.col("instrument") == "FUTIDX") | truthy("bullish"))


def score_oi(setups: DataFrame) -> DataFrame:
    raw = (F.abs("oi_chg") * 0.6 + F.abs("px_chg") * 0.4) * 500
    return setups.withColumn("alpha_score", F.least(F.lit(99), raw.cast("int")))


def oi_score(setups: DataFrame, n: int = 15) -> DataFrame:
    return score_oi(setups).orderBy(F.col("alpha_score").desc(), "symbol", "date").limit(n)


def instrument_tag(symbol, instrument, index_tags: tuple[str, ...] = INDEX_TAGS):
    """Index futures carry the first index name their symbol holds, all others STOCK."""
    s, i = col_of(symbol), col_of(instrument)
    tag = F.lit("INDEX")
    for name in reversed(index_tags):
        tag = F.when(s.contains(name), name).otherwise(tag)
    return F.when(i == "FUTIDX", tag).otherwise("STOCK")


def build_spread(signals: DataFrame) -> DataFrame:
    """Strikes and type of the debit spread of a Long or Short Buildup."""
    long_side = F.col("state") == LONG_BUILDUP
    width = F.lit(None).cast("double")
    for name, w in INDEX_WIDTHS.items():
        width = F.when(F.col("symbol") == name, w).otherwise(width)
    atm = round_strike("close")
    far = F.when(long_side, round_strike(F.col("close") * UP_STRIKE)).otherwise(
        round_strike(F.col("close") * DOWN_STRIKE)
    )
    otm = F.coalesce(F.when(long_side, atm + width).otherwise(atm - width), far)
    return (
        signals.where(F.col("state").isin(LONG_BUILDUP, SHORT_BUILDUP))
        .withColumn("option_type", F.when(long_side, "CE").otherwise("PE"))
        .withColumn("action", F.when(long_side, BULL_CALL).otherwise(BEAR_PUT))
        .withColumn("atm_strike", atm)
        .withColumn("otm_strike", otm)
    )


def price_spread(spreads: DataFrame, chain: DataFrame, capital: float = 1_000_000.0,
                 risk: float = 0.02) -> DataFrame:
    """Net debit, risk-limited lots and the two firewalls.

    Dropped: debit <= 0, debit >= strike width, risk above 1.1 times the limit.
    """
    limit = capital * risk
    lot = F.when(F.col("lot_size") == 0, 50).otherwise(F.col("lot_size"))
    legs = two_legs(spreads, chain).withColumn("lot_size", lot)
    debit = F.col("atm_close") - F.col("otm_close")
    priced = (
        legs.withColumn("net_debit", debit)
        .where(F.col("net_debit") > 0)
        .withColumn("width", F.abs(F.col("atm_strike") - F.col("otm_strike")))
        .withColumn("lots", F.greatest(F.lit(1), div(F.lit(limit), F.col("net_debit") * F.col("lot_size")).cast("int")))
        .withColumn("risk_rs", F.col("lots") * F.col("lot_size") * F.col("net_debit"))
    )
    return priced.where(
        (F.col("net_debit") < F.col("width")) & (F.col("risk_rs") <= limit * 1.1)
    ).withColumn("max_profit_rs", (F.col("width") - F.col("net_debit")) * F.col("lot_size") * F.col("lots"))


def legs_held(months: DataFrame, chain: DataFrame) -> DataFrame:
    """date, atm_close and otm_close of every day in (entry, expiry] on which both legs of a spread are quoted.

    months has a row per spread and month. Rows meet by (symbol, month) and the chain streams past them, as in two_legs.
    """
    if "month" not in chain.columns:
        chain = chain.withColumn("month", F.trunc("date", "month"))
    for leg in ("atm", "otm"):
        c = chain.select("symbol", "month", F.col("date").alias("_date"), F.col("option_type").alias("_type"), F.col("expiry_dt").alias("_expiry"),
                         F.col("strike").alias("_strike"), F.col("close").alias(f"{leg}_close"))
        day = alike(F.col("_date"), F.col("date")) if leg == "otm" else (F.col("_date") > F.col("entry_date")) & (F.col("_date") <= F.col("expiry_dt"))
        met = months.hint("shuffle_hash").join(c, ["symbol", "month"]).where(
            alike(F.col("_type"), F.col("option_type")) & alike(F.col("_expiry"), F.col("expiry_dt"))
            & alike(F.col("_strike"), F.col(f"{leg}_strike")) & day)
        months = (met.withColumnRenamed("_date", "date") if leg == "atm" else met.drop("_date")).drop("_type", "_expiry", "_strike")
    return months


def take_profit_exit(spreads: DataFrame, chain: DataFrame, share: float = TAKE_PROFIT, parts: int | None = None) -> DataFrame:
    """First later date on which the spread has earned `share` of its best case; NULL when never.

    A spread goes to each month in which it may be held, and meets the quotes of its legs there. `parts` is the number of
    partitions by (symbol, month) in which a chain with a column month lies: then the chain, the larger side, is not moved.
    """
    keys = ["symbol", "entry_date", "option_type", "expiry_dt"]
    s = cut(spreads.withColumnRenamed("date", "entry_date"), "spreads-held")
    first, last = (F.trunc(d, "month") for d in (F.date_add("entry_date", 1), F.col("expiry_dt")))
    months = (
        s.where(F.col("entry_date") < F.col("expiry_dt"))
        .select(*keys, "atm_strike", "otm_strike", "net_debit", "lot_size", "lots", "max_profit_rs",
                F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month"))
    )
    if parts is not None:
        months = months.repartition(parts, "symbol", "month")
    walk = (
        legs_held(months, chain)
        .withColumn("debit_now", F.col("atm_close") - F.col("otm_close"))
        .withColumn("pnl", (F.col("debit_now") - F.col("net_debit")) * F.col("lot_size") * F.col("lots"))
        .where(F.col("pnl") >= F.col("max_profit_rs") * share)
        .groupBy(*keys)
        .agg(F.min("date").alias("exit_date"), F.min_by("pnl", "date").alias("exit_pnl"),
             F.min_by("debit_now", "date").alias("exit_premium"))
    )
    return s.join(walk, keys, "left")


def expiry_payoff(spreads: DataFrame, fut: DataFrame) -> DataFrame:
    """Settlement at the last underlying row in (entry, expiry]: full, zero or intrinsic.

    `spreads` has entry_date. A spread without a later underlying row is dropped.
    """
    keys = ["symbol", "entry_date", "option_type", "expiry_dt"]
    spreads = cut(spreads, "spreads-settled")
    last = (
        range_join(spreads.select(*keys), fut.select("symbol", "date", F.col("close").alias("spot")),
                   "entry_date", "expiry_dt")
        .groupBy(*keys).agg(F.max("date").alias("settle_date"), F.max_by("spot", "date").alias("settle_spot"))
    )
    sign = F.when(F.col("option_type") == "CE", 1.0).otherwise(-1.0)
    gain = sign * (F.col("settle_spot") - F.col("atm_strike"))
    worth = F.when(gain >= F.col("width"), F.col("width")).when(gain <= 0, 0.0).otherwise(gain)
    return (
        spreads.join(last, keys)
        .withColumn("settle_premium", worth)
        .withColumn("settle_pnl", (F.col("settle_premium") - F.col("net_debit")) * F.col("lot_size") * F.col("lots"))
    )


def spread_exits(spreads: DataFrame, chain: DataFrame, fut: DataFrame, parts: int | None = None) -> DataFrame:
    """Journal rows: early exit when there is one, settlement otherwise. `parts` as in take_profit_exit."""
    early = take_profit_exit(spreads, chain, parts=parts)
    out = expiry_payoff(early, fut)
    hit = F.col("exit_date").isNotNull()
    return out.select(
        "symbol", "entry_date", "action", "option_type", "atm_strike", "otm_strike", "expiry_dt", "lots", "net_debit",
        F.coalesce("exit_date", "settle_date").alias("exit_date"),
        F.coalesce("exit_premium", "settle_premium").alias("exit_premium"),
        F.coalesce("exit_pnl", "settle_pnl").alias("pnl"),
        F.when(hit, EARLY_EXIT).otherwise(EXPIRY_EXIT).alias("note"),
    )


def order_by_reward(spreads: DataFrame, n: int | None = None) -> DataFrame:
    """Best reward per risk first."""
    out = spreads.withColumn("reward_risk", div("max_profit_rs", "risk_rs")).orderBy(
        F.col("reward_risk").desc(), "symbol", "date"
    )
    return out if n is None else out.limit(n)
