"""Selection, weights, sizing and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import div, finite, truthy
from ..functions.windows import last_n
from .calendar import rebalance_steps

# Cost rates of the itemised model.
BROKERAGE = 0.0003
SELL_TAX = 0.001
REGULATORY = 0.0002
IMPACT = 0.0005

# Slippage by share of average daily volume.
ADV_TIERS = ((0.02, 0.0050), (0.05, 0.0075), (0.10, 0.0100))
ADV_TOP = 0.0150

# Status texts of the signal document.
STATUS_NEW, STATUS_KEPT = "NEW ENTRY", "HOLD (Buffer)"
STATUS_FLUSHED, STATUS_WATCHED = "CASH SECURED", "OBSERVATION ONLY"

# Volatility bands and bounds of the leverage rule.
VOL_CALM, VOL_STORM, VOL_TARGET = 0.15, 0.35, 0.30
LEVERAGE_MIN, LEVERAGE_MAX = 0.5, 1.5


def _fold_selection(ranked: DataFrame, depth: int, keys: list[str], step) -> DataFrame:
    """Run a selection rule over the dates of each configuration.

    The input is cut to `depth` names per date before anything is collected, so
    an array holds (dates of the calendar) x depth short strings at most. The
    recursion over dates is a fold in the JVM.
    """
    per_date = (
        ranked.where(F.col("rank") <= depth)
        .groupBy(*keys, "date")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "ticker"))), lambda x: x["ticker"]).alias("names"),
        )
    )
    state = "struct<held:array<string>,out:array<struct<date:date,names:array<string>>>>"
    folded = per_date.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("date", "names"))).alias("days")
    ).withColumn(
        "out",
        F.aggregate(
            "days",
            F.expr(f"cast(named_struct('held', array(), 'out', array()) as {state})"),
            lambda acc, d: F.element_at(F.transform(F.array(step(acc["held"], d["names"])), lambda now: F.struct(
                now.alias("held"),
                F.array_append(acc["out"], F.struct(d["date"].alias("date"), now.alias("names"))).alias("out"),
            ).cast(state)), 1),
            lambda a: a["out"],
        ),
    )
    return folded.select(*keys, F.explode("out").alias("d")).select(
        *keys, F.col("d.date").alias("date"), F.posexplode("d.names").alias("slot", "ticker")
    ).withColumn("slot", F.col("slot") + 1)


def hold_buffer(ranked: DataFrame, top_n=5, buffer=15, keys=("config_id",), depth: int | None = None,
                dates: DataFrame | None = None) -> DataFrame:
    """Keep held names ranked within the buffer, fill to top_n from the best others.

    ranked: keys, date, ticker, rank. top_n and buffer are numbers, or key
    columns that differ by configuration, then with a common `depth`. With the
    rebalance `dates`, a date without candidates empties the book, and nothing is
    remembered beyond it.
    """
    n, b = (F.lit(x) if isinstance(x, int) else x for x in (top_n, buffer))

    def step(held, names):
        kept = F.array_intersect(F.slice(names, F.lit(1), b), held)
        fresh = F.array_except(names, kept)
        return F.concat(kept, F.slice(fresh, F.lit(1), F.greatest(F.lit(0), n - F.size(kept))))

    keys, depth = list(keys), depth or top_n + buffer
    if dates is None:
        return _fold_selection(ranked, depth, keys, step)
    # Dates in a row share a spell; each spell is folded by itself.
    steps = rebalance_steps(ranked, keys, dates).join(ranked.select(*keys, "date").distinct(), [*keys, "date"])
    spell = F.col("step") - F.row_number().over(W.partitionBy(*keys).orderBy("date"))
    ranked = ranked.join(steps.select(*keys, "date", spell.alias("_spell")), [*keys, "date"])
    return _fold_selection(ranked, depth, [*keys, "_spell"], step).drop("_spell")


def hold_buffer_v1(ranked: DataFrame, top_n: int = 5, buffer: int = 15, keys=("config_id",)) -> DataFrame:
    """Keep held names in the buffer, add only from the best top_n, cut to top_n;
    with fewer than top_n candidates all of them are held."""

    def step(held, names):
        kept = F.array_intersect(F.slice(names, 1, buffer), held)
        best = F.slice(names, 1, top_n)
        joined = F.concat(kept, F.array_except(best, kept))
        return F.when(F.size(names) < top_n, names).otherwise(F.slice(joined, 1, top_n))

    return _fold_selection(ranked, buffer, list(keys), step)


# A basket is one target portfolio: what top-n and the hold buffer let through.
# It is bounded by the selection size, so basket sums are windows over the basket
# keys, which share one exchange however many weight steps follow.


def equal_weights(sel: DataFrame, keys=("date",)) -> DataFrame:
    return sel.withColumn("weight", 1.0 / F.count(F.lit(1)).over(W.partitionBy(*keys)))


def inverse_vol_weights(sel: DataFrame, vol: str = "vol", default: float = 0.20, keys=("date",),
                        floor: float | None = None) -> DataFrame:
    """Weights proportional to 1 / vol; zero or missing vol takes the default."""
    v = F.coalesce(F.nullif(finite(vol), F.lit(0.0)), F.lit(default))
    if floor is not None:
        v = F.greatest(v, F.lit(floor))
    return sel.withColumn("_iv", 1.0 / v).withColumn(
        "weight", F.col("_iv") / F.sum("_iv").over(W.partitionBy(*keys))
    ).drop("_iv")


def momentum_weights(sel: DataFrame, mom: str = "mom", keys=("date",)) -> DataFrame:
    """Weights proportional to positive momentum, equal when none is positive."""
    w = W.partitionBy(*keys)
    rows = sel.withColumn("_m", F.greatest(F.coalesce(finite(mom), F.lit(0.0)), F.lit(0.0)))
    total = F.sum("_m").over(w)
    return rows.withColumn(
        "weight", F.when(total > 0, F.col("_m") / total).otherwise(1.0 / F.count(F.lit(1)).over(w))
    ).drop("_m")


def cap_weights(weights: DataFrame, cap: float, rounds: int, keys=("date",)) -> DataFrame:
    """Clip at the cap and hand the overflow to the names not clipped yet, up to `rounds` times.

    Every effective round clips at least one name, so rounds = basket size is exact.
    """
    w = W.partitionBy(*keys)
    out = weights.withColumn("_capped", F.lit(False))
    for _ in range(rounds):
        hit = (F.col("weight") > cap) & ~F.col("_capped")
        free = ~hit & ~F.col("_capped")
        x = F.col("weight")
        out = (
            out.withColumn("_hit", hit)
            .withColumn("_over", F.sum(F.when(hit, x - cap).otherwise(0.0)).over(w))
            .withColumn("_room", F.sum(F.when(free, x).otherwise(0.0)).over(w))
            .withColumn("_free", F.count_if(free).over(w).cast("double"))
            .withColumn(
                "weight",
                F.when(F.col("_hit"), F.lit(cap))
                .when(F.col("_capped") | (F.col("_over") == 0), x)
                .when(F.col("_room") > 0, x + F.col("_over") * (x / F.nullif("_room", F.lit(0.0))))
                .otherwise(x + F.col("_over") / F.nullif("_free", F.lit(0.0))),
            )
            .withColumn("_capped", F.col("_capped") | F.col("_hit"))
            .drop("_hit", "_over", "_room", "_free")
        )
    return out.drop("_capped")


def scale_weights(weights: DataFrame, exposure: DataFrame) -> DataFrame:
    """Multiply by the exposure of the date (date, exposure); a date without one gets zero."""
    return weights.join(exposure.select("date", "exposure"), "date", "left").withColumn(
        "weight", F.col("weight") * F.coalesce("exposure", F.lit(0.0))
    )


def size_shares(weights: DataFrame, capital: float, vol_cap: float = 0.05, variant: str = "strict") -> DataFrame:
    """Whole shares, capped by a share of the five-row mean volume.

    strict: no volume means no shares; lenient: no volume means no cap.
    """
    want = F.when(F.col("price") > 0, (F.col("weight") * capital / F.nullif("price", F.lit(0.0))).cast("long")).otherwise(0)
    limit = (F.coalesce("avg_volume5", F.lit(0.0)) * vol_cap).cast("long")
    if variant == "lenient":
        shares = F.when(limit > 0, F.least(want, limit)).otherwise(want)
    else:
        shares = F.least(want, limit)
    return weights.withColumn("max_volume_shrs", limit).withColumn("target_shrs", shares)


def label_orders(sized: DataFrame, held: DataFrame, flush: bool = False) -> DataFrame:
    """BUY / HOLD for the selection (TRACK while flushing) and TRACK for buffer names.

    `sized` has selected (bool), weight and target_shrs.
    """
    j = sized.join(held.select("ticker").distinct().withColumn("_h", F.lit(True)), "ticker", "left")
    selected = F.col("selected")
    active = selected & F.lit(not flush)
    return (
        j.withColumn("signal", F.when(~active, "TRACK").when(truthy("_h"), "HOLD").otherwise("BUY"))
        .withColumn(
            "tech_status",
            F.when(~selected, STATUS_WATCHED).when(~active, STATUS_FLUSHED)
            .when(truthy("_h"), STATUS_KEPT).otherwise(STATUS_NEW),
        )
        .withColumn("allocation_pct", F.when(active, F.round(F.col("weight") * 100, 1)).otherwise(0.0))
        .withColumn("target_shrs", F.when(active, F.col("target_shrs")).otherwise(F.lit(0)))
        .drop("_h")
    )


def flush_list(held: DataFrame, regime: DataFrame) -> DataFrame:
    """Everything held is sold on dates whose regime is not bullish."""
    bear = regime.where(~truthy("bullish")).select("date")
    return held.join(bear, "date", "left_semi").withColumn("action", F.lit("sell"))


def weight_changes(weights: DataFrame, keys=("config_id",), dates: DataFrame | None = None) -> DataFrame:
    """keys, date, ticker, old_weight, weight for every name held now or one rebalance ago.

    The previous book is the same table moved to the next rebalance date, so
    this is one equi join on (keys, date, ticker). With `dates` a book that is
    emptied is sold on the rebalance on which it is.
    """
    keys = list(keys)
    nxt = rebalance_steps(weights, keys, dates).select(*keys, "date", F.col("next_date").alias("_next"))
    old = weights.select(*keys, "date", "ticker", F.col("weight").alias("old_weight")).join(
        nxt, [*keys, "date"]
    ).where(F.col("_next").isNotNull()).select(*keys, F.col("_next").alias("date"), "ticker", "old_weight")
    new = weights.select(*keys, "date", "ticker", "weight")
    return new.join(old, [*keys, "date", "ticker"], "full_outer").fillna({"weight": 0.0, "old_weight": 0.0})


def turnover(weights: DataFrame, keys=("config_id",), dates: DataFrame | None = None) -> DataFrame:
    return weight_changes(weights, keys, dates).groupBy(*keys, "date").agg(
        F.sum(F.abs(F.col("weight") - F.col("old_weight"))).alias("turnover")
    )


def cost_drag(turn: DataFrame, one_way: float, leverage: float = 1.0) -> DataFrame:
    return turn.withColumn("drag", F.col("turnover") * one_way * leverage)


def itemised_cost(weights: DataFrame, keys=("config_id",)) -> DataFrame:
    """Brokerage, sell tax, regulatory charge and impact per rebalance."""
    ch = weight_changes(weights, keys)
    moved = F.sum(F.abs(F.col("weight") - F.col("old_weight")))
    sold = F.sum(F.greatest(F.col("old_weight") - F.col("weight"), F.lit(0.0)))
    return ch.groupBy(*keys, "date").agg(
        (moved * BROKERAGE).alias("brokerage"), (sold * SELL_TAX).alias("sell_tax"),
        (moved * REGULATORY).alias("regulatory"), (moved * IMPACT).alias("impact"),
    ).withColumn("cost", F.col("brokerage") + F.col("sell_tax") + F.col("regulatory") + F.col("impact"))


def adv_slippage(orders: DataFrame) -> DataFrame:
    """Slippage rate by participation = shares / average daily volume."""
    p = div("shares", "adv")
    rate = F.lit(ADV_TOP)
    for limit, r in reversed(ADV_TIERS):
        rate = F.when(p <= limit, r).otherwise(rate)
    return orders.withColumn("participation", p).withColumn("slippage", F.when(p.isNull(), ADV_TOP).otherwise(rate))


def gap_slippage(orders: DataFrame, gap: float = 0.02, addon: float = 0.005) -> DataFrame:
    return orders.withColumn(
        "gap_slippage", F.when(truthy(F.col("exec_gap") > gap), addon).otherwise(0.0)
    )


def vol_target_leverage(equity: DataFrame, n: int = 20, key: str = "portfolio") -> DataFrame:
    """Leverage from the population vol of the last n returns: up to 1.5 in calm,
    down to 0.5 in storms, 1 in between and while warming up."""
    w = last_n(n, key)
    vol = F.stddev_pop("ret").over(w) * F.sqrt(F.lit(252.0))
    full = F.count("ret").over(w) == n
    return (
        equity.withColumn("_v", F.when(full, vol))
        .withColumn(
            "leverage",
            F.when(F.col("_v") < VOL_CALM, F.least(F.lit(LEVERAGE_MAX), VOL_TARGET / (F.col("_v") + 0.01)))
            .when(F.col("_v") > VOL_STORM, F.greatest(F.lit(LEVERAGE_MIN), VOL_TARGET / (F.col("_v") + 0.01)))
            .otherwise(F.lit(1.0)),
        )
        .drop("_v")
    )


def no_trade_band(book: DataFrame, nav: float, band: float = 0.02) -> DataFrame:
    """Keep the current value when the target differs by no more than band * nav."""
    move = F.abs(F.col("target") - F.col("current")) > band * nav
    return book.withColumn("trade", move).withColumn(
        "new_value", F.when(move, F.col("target")).otherwise(F.col("current"))
    )
