"""Ledger operators: balances, average cost, snapshots, benchmark, breaker.

A strategy or a symbol may hold any share of all trades. Trades are therefore
first reduced per hour or day, running sums run over those (bounded by the
calendar), and single trades are only ordered inside one hour. Average cost walks
the trades of a symbol in order, and takes that road for symbols with many trades only.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import div, truthy
from ..functions.folds import fold
from ..functions.windows import keep_last, lag, running
from ..schemas import BreakerLimits
from ..sources.scratch import cut
from .joins import asof_join
from .metrics import max_drawdown, sharpe_of

KEYS = ["strategy", "symbol"]
FLAT = 1e-6


def _signed(value):
    return F.when(F.col("side") == "buy", value).otherwise(-value)


def replay_cash(trades: DataFrame, initial: float, dates: DataFrame | None = None) -> DataFrame:
    """strategy, date, cash at the end of each trading day (or of the given dates)."""
    flow = trades.groupBy("strategy", "date").agg(
        F.sum(-_signed(F.col("qty") * F.col("price"))).alias("flow")
    )
    cash = flow.select("strategy", "date", (F.lit(initial) + running(F.sum, "flow", "strategy")).alias("cash"))
    if dates is None:
        return cash
    grid = _strategy_grid(trades, dates)
    return asof_join(grid, cash, ["strategy"], "date", {"cash": float(initial)}, left_unique=True)


def _strategy_grid(trades: DataFrame, dates: DataFrame) -> DataFrame:
    """Every strategy on every date; the dates of a calendar travel as one array."""
    days = dates.select("date").distinct().agg(F.collect_list("date").alias("a")).scalar()
    return trades.select("strategy").distinct().select("strategy", F.explode(days).alias("date"))


def replay_quantities(trades: DataFrame) -> DataFrame:
    """strategy, symbol, date, next_date, qty: holdings as intervals, flat ones dropped.

    Intervals instead of one row per symbol and day keep the result as large as
    the trading activity.
    """
    net = trades.groupBy(*KEYS, "date").agg(F.sum(_signed(F.col("qty"))).alias("net"))
    w = W.partitionBy(*KEYS).orderBy("date")
    return net.select(
        *KEYS, "date", F.lead("date").over(w).alias("next_date"), running(F.sum, "net", KEYS).alias("qty")
    ).where(F.col("qty") > 1e-5)


def portfolio_values(trades: DataFrame, prices: DataFrame, initial: float) -> DataFrame:
    """strategy, date, cash, holdings, portfolio_value on days with a trade or a price.

    A symbol's market value only changes when it trades or gets a new price.
    The changes are summed per strategy and day and then run over the calendar,
    so the work follows the events and not symbols times days.
    """
    net = trades.groupBy(*KEYS, "date").agg(F.sum(_signed(F.col("qty"))).alias("net"))
    owners = trades.select(*KEYS).distinct()
    marks = owners.join(prices.select(F.col("ticker").alias("symbol"), "date", "close"), "symbol")
    ev = net.join(marks, [*KEYS, "date"], "full_outer")
    w = W.partitionBy(*KEYS).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    ev = ev.withColumn("qty", F.coalesce(F.sum("net").over(w), F.lit(0.0))).withColumn(
        "px", F.coalesce(F.last("close", ignorenulls=True).over(w), F.lit(0.0))
    )
    mv = F.when(F.col("qty") > 1e-5, F.col("qty") * F.col("px")).otherwise(0.0)
    ev = ev.withColumn("mv", mv)
    ev = ev.withColumn("delta", F.col("mv") - F.coalesce(lag("mv", 1, KEYS), F.lit(0.0)))
    daily = ev.groupBy("strategy", "date").agg(F.sum("delta").alias("delta"))
    flow = trades.groupBy("strategy", "date").agg(F.sum(-_signed(F.col("qty") * F.col("price"))).alias("flow"))
    both = daily.join(flow, ["strategy", "date"], "left").fillna(0.0, ["flow"])
    return both.select(
        "strategy", "date", (F.lit(initial) + running(F.sum, "flow", "strategy")).alias("cash"),
        running(F.sum, "delta", "strategy").alias("holdings"),
    ).withColumn("portfolio_value", F.col("cash") + F.col("holdings"))


#: Trades of a symbol up to which they are walked in one go; a symbol with more is settled by hours, in parallel.
WALKED_TRADES = 1_000_000


def average_cost(trades: DataFrame, walked: int = WALKED_TRADES) -> DataFrame:
    """Adds qty_after, avg_cost (NULL once flat) and realised to every accepted trade.

    A buy re-averages, a sale keeps the average, and a flat position starts
    anew. The cost value c follows c' = a * c + b with a = 1, b = qty * price
    for a buy and a = qty_after / qty_before, b = 0 for a sale. Trades move once:
    a symbol's trades are walked in order, from batch to batch, without collecting
    them. Only symbols of more than `walked` trades are settled by hours. Trades
    without strategy, symbol or time are dropped.
    """
    return _settled(trades, walked, _cost_walked, _cost_by_hours)


def _settled(trades: DataFrame, walked: int, few, many) -> DataFrame:
    """few(trades) of the symbols of up to `walked` trades, and many(trades) of the others."""
    large = trades.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > walked).select(*KEYS)
    large = cut(large, "large-symbols")
    if large.isEmpty():
        return few(trades)
    return few(trades.join(large, KEYS, "left_anti")).unionByName(many(trades.join(large, KEYS, "left_semi")))


class _Position:
    """Quantity and cost of one symbol, trade by trade: per hour and spell between flat positions, as `_cost_by_hours` sums them."""

    def __init__(self):
        self.held, self.cost, self.hour = 0.0, 0.0, None
        self._open()

    def _open(self) -> None:
        self.known, self.flats, self.flat, self.factor, self.bought, self.last = False, 0, False, None, 0.0, None

    def _close(self) -> None:
        a, c, m = (0.0 if self.flats else self.factor), self.cost, self.factor
        self.cost = None if a is None or c is None or m is None else a * c + m * self.bought
        self._open()

    def trade(self, hour, side, qty, price) -> tuple[float | None, float | None, float | None]:
        """qty_after, avg_cost and realised; a trade without time only counts for the quantity."""
        if hour != self.hour:
            if self.hour is not None:
                self._close()
            self.hour = hour
        buy = side == "buy"
        signed = None if qty is None else qty if buy else -qty
        if signed is not None:
            self.held, self.known = self.held + signed, True
        if hour is None:
            self.known = False
            return None, None, None
        after = self.held if self.known else None
        before = None if after is None or signed is None else after - signed
        if self.flat:
            self.flats, self.factor, self.bought = self.flats + 1, None, 0.0
        self.flat = after is not None and after < FLAT
        a = 1.0 if buy else 0.0 if self.flat else after / before if after is not None and before else None
        if a is not None:
            self.factor = a if self.factor is None else self.factor * a
        if buy and self.factor and qty is not None and price is not None:
            self.bought += qty * price / self.factor
        prior = self.cost if self.last is None else self.last
        start = 0.0 if self.flats else self.cost
        self.last = None if self.factor is None or start is None else self.factor * (start + self.bought)
        average = self.last / after if after and not self.flat and self.last is not None else None
        realised = None
        if side is not None and not buy and before and None not in (prior, price):
            realised = (price - prior / before) * qty
        return after, average, realised


_WALK = T.StructType([T.StructField(c, T.DoubleType()) for c in ("qty_after", "avg_cost", "realised")])


def _in_order(trades: DataFrame, columns: list[str]) -> DataFrame:
    """The trades of a symbol in one partition and in order: `columns`, and the six that a position reads."""
    known = trades.where(F.col("strategy").isNotNull() & F.col("symbol").isNotNull())
    number = lambda c: F.col(c).cast("double").alias(f"_{c}")
    return known.repartition(*KEYS).sortWithinPartitions(*KEYS, "ts", "trade_id").select(
        *columns, F.col("strategy").alias("_strategy"), F.col("symbol").alias("_symbol"),
        F.date_trunc("hour", "ts").cast("long").alias("_hour"), F.col("side").alias("_side"), number("qty"), number("price"))


def _cost_walked(trades: DataFrame) -> DataFrame:
    schema = T.StructType([*trades.schema.fields, *_WALK.fields])

    def walk(batches):
        key, at = None, None
        for batch in batches:
            kept, done = [], []
            for i, (*k, hour, side, qty, price) in enumerate(zip(*(x.to_pylist() for x in batch.columns[-6:]))):
                if k != key:
                    key, at = k, _Position()
                value = at.trade(hour, side, qty, price)
                if hour is not None:
                    kept.append(i)
                    done.append(value)
            if kept:
                out = [x.take(pa.array(kept)) for x in batch.columns[:-6]]
                yield pa.RecordBatch.from_arrays([*out, *(pa.array(v, pa.float64()) for v in zip(*done))], names=schema.names)

    return _in_order(trades, trades.columns).mapInArrow(walk, schema)


def _last_walked(trades: DataFrame) -> DataFrame:
    schema = T.StructType([*trades.select(*KEYS).schema.fields, *_WALK.fields[:2]])
    kinds = [pa.string(), pa.string(), pa.float64(), pa.float64()]

    def walk(batches):
        key, at, ended, done = None, None, None, []
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), kinds)], names=schema.names)
        for batch in batches:
            done = []
            for *k, hour, side, qty, price in zip(*(x.to_pylist() for x in batch.columns)):
                if k != key:
                    if ended is not None:
                        done.append(ended)
                    key, at, ended = k, _Position(), None
                value = at.trade(hour, side, qty, price)
                if hour is not None:
                    ended = (*k, *value[:2])
            if done:
                yield rows()
        if ended is not None:
            done = [ended]
            yield rows()

    return _in_order(trades, []).mapInArrow(walk, schema)


def _cost_by_hours(trades: DataFrame) -> DataFrame:
    """Maps of cost value compose, so each hour is reduced to one (a, b), the hours of a
    symbol are folded in order, and every trade is then finished inside its own hour.
    """
    t = trades.withColumn("chunk", F.date_trunc("hour", F.col("ts"))).withColumn("_sq", _signed(F.col("qty")))
    chunks = t.groupBy(*KEYS, "chunk").agg(F.sum("_sq").alias("_net"))
    before = W.partitionBy(*KEYS).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select(*KEYS, "chunk", F.coalesce(F.sum("_net").over(before), F.lit(0.0)).alias("_q0"))
    inside = W.partitionBy(*KEYS, "chunk").orderBy("ts", "trade_id")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    t = t.join(chunks, [*KEYS, "chunk"]).withColumn("qty_after", F.col("_q0") + F.sum("_sq").over(upto))
    t = t.withColumn("_qb", F.col("qty_after") - F.col("_sq")).withColumn("_flat", F.col("qty_after") < FLAT)
    buy = F.col("side") == "buy"
    t = (
        t.withColumn("_a", F.when(buy, 1.0).when(F.col("_flat"), 0.0).otherwise(
            F.col("qty_after") / F.nullif("_qb", F.lit(0.0))))
        .withColumn("_b", F.when(buy, F.col("qty") * F.col("price")).otherwise(0.0))
        .withColumn("_ep", F.coalesce(F.sum(F.when(F.col("_flat"), 1).otherwise(0)).over(
            inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    )
    spell = W.partitionBy(*KEYS, "chunk", "_ep").orderBy("ts", "trade_id").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("_m", F.product("_a").over(spell)).withColumn(
        "_d", F.coalesce(F.sum(F.when(buy, F.col("_b") / F.nullif("_m", F.lit(0.0)))).over(spell), F.lit(0.0))
    )
    ends = t.groupBy(*KEYS, "chunk").agg(
        F.max_by(F.struct("_ep", "_m", "_d"), F.struct("ts", "trade_id")).alias("e")
    ).select(
        *KEYS, "chunk", F.when(F.col("e._ep") == 0, F.col("e._m")).otherwise(0.0).alias("a"),
        (F.col("e._m") * F.col("e._d")).alias("b"),
    )
    costs = ends.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("chunk", "a", "b"))).alias("rows")).withColumn(
        # The output of an hour is the value before it.
        "c0", fold(F.col("rows"), F.lit(0.0), "double", "double", lambda c, x: (x["a"] * c + x["b"], c))
    ).select(*KEYS, F.explode(F.arrays_zip("rows", "c0")).alias("z")).select(
        *KEYS, F.col("z.rows.chunk").alias("chunk"), F.col("z.c0").alias("_c0")
    )
    t = t.join(costs, [*KEYS, "chunk"]).withColumn(
        "_c", F.col("_m") * (F.when(F.col("_ep") == 0, F.col("_c0")).otherwise(0.0) + F.col("_d"))
    )
    c_before = F.coalesce(F.lag("_c").over(inside), F.col("_c0"))
    avg_before = div(c_before, "_qb")
    return t.withColumn("avg_cost", F.when(~F.col("_flat"), div("_c", "qty_after"))).withColumn(
        "realised", F.when(~buy, (F.col("price") - avg_before) * F.col("qty"))
    ).select(*trades.columns, "qty_after", "avg_cost", "realised")


def realised_pnl(trades: DataFrame) -> DataFrame:
    return average_cost(trades).where(F.col("side") == "sell").select(*trades.columns, "realised")


def _last_by_hours(trades: DataFrame) -> DataFrame:
    last = _cost_by_hours(trades).groupBy(*KEYS).agg(F.max_by(F.struct("qty_after", "avg_cost"), F.struct("ts", "trade_id")).alias("p"))
    return last.select(*KEYS, "p.qty_after", "p.avg_cost")


def open_positions(trades: DataFrame, walked: int = WALKED_TRADES) -> DataFrame:
    """strategy, symbol, qty, avg_cost after the last trade; flat ones are gone."""
    trades = trades.select(*KEYS, "side", "qty", "price", "ts", "trade_id")
    last = _settled(trades, walked, _last_walked, _last_by_hours)
    return last.select(*KEYS, F.col("qty_after").alias("qty"), "avg_cost").where(F.col("qty") >= FLAT)


def last_prices(trades: DataFrame) -> DataFrame:
    """symbol, price of its last trade. Only trades of a symbol's last moment are compared by id, so no trade is moved or sorted."""
    newest = cut(trades.groupBy("symbol").agg(F.max("ts").alias("ts")), "last-moments")
    last = trades.join(newest, ["symbol", "ts"], "left_semi")
    return last.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "trade_id")).alias("price"))


def mark_to_market(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """prices: symbol, price. Adds market value and unrealised P&L, in currency and percent."""
    j = positions.join(prices.select("symbol", "price"), "symbol", "left")
    return j.withColumn("market_value", F.col("qty") * F.col("price")).withColumn(
        "unrealised", (F.col("price") - F.col("avg_cost")) * F.col("qty")
    ).withColumn("unrealised_pct", (div("price", "avg_cost") - 1) * 100)


def portfolio_totals(marked: DataFrame, cash: DataFrame, initial: float) -> DataFrame:
    t = marked.groupBy("strategy").agg(
        F.sum("market_value").alias("holdings"), F.sum("unrealised").alias("unrealised"),
        F.count(F.lit(1)).alias("names"),
    )
    out = cash.select("strategy", "cash").join(t, "strategy", "left").fillna(0.0, ["holdings", "unrealised"]).fillna(0, ["names"])
    value = F.col("cash") + F.col("holdings")
    return out.withColumn("portfolio_value", value).withColumn("total_return", (value / F.lit(initial) - 1) * 100)


def daily_snapshots(values: DataFrame, initial: float) -> DataFrame:
    """P&L against the day before, against the starting capital on the first day."""
    prev = F.coalesce(lag("portfolio_value", 1, "strategy"), F.lit(float(initial)))
    return values.withColumn("daily_pnl", F.col("portfolio_value") - prev).withColumn(
        "daily_pnl_pct", div(F.col("daily_pnl"), prev) * 100
    )


def complete_prices_only(marked: DataFrame, keys=("strategy",)) -> DataFrame:
    """Rows of strategies whose every position has a positive price."""
    bad = marked.where(F.coalesce("price", F.lit(0.0)) <= 0).select(*keys).distinct()
    return marked.join(bad, list(keys), "left_anti")


def rebase_benchmark(index_bars: DataFrame, inception, initial: float) -> DataFrame:
    """date, close, bench_value: the last close before inception is worth the starting capital."""
    day = F.lit(inception).cast("date")
    base = index_bars.agg(
        F.coalesce(F.max_by(F.when(F.col("date") < day, F.col("close")), F.when(F.col("date") < day, F.col("date"))),
                   F.min_by("close", "date")).alias("b")
    ).scalar()
    return index_bars.where(F.col("date") >= day).select(
        "date", "close", (F.col("close") / base * initial).alias("bench_value")
    )


def benchmark_metrics(grid: DataFrame, initial: float, rf: float = 0.065, keys=("portfolio",)) -> DataFrame:
    """Totals, excess return, beta, Sharpe and drawdowns of portfolio against benchmark.

    grid: keys, date, portfolio_value, bench_value. Beta is 1 without benchmark
    variance; Sharpe is 0 without variance and -999 below six rows.
    """
    keys = list(keys)
    r = lambda c: F.coalesce(div(c, lag(c, 1, keys)) - 1, F.lit(0.0))
    rows = grid.withColumn("pr", r("portfolio_value")).withColumn("br", r("bench_value"))
    for c, n in (("portfolio_value", "pdd"), ("bench_value", "bdd")):
        peak = F.greatest(running(F.max, c, keys), F.lit(float(initial)))
        rows = rows.withColumn(n, F.col(c) / peak - 1)
    total = lambda c: (F.max_by(c, "date") / initial - 1) * 100
    n, var, sd = F.count(F.lit(1)), F.var_samp("br"), F.stddev_samp("pr")
    return rows.groupBy(*keys).agg(
        total("portfolio_value").alias("portfolio_return"), total("bench_value").alias("bench_return"),
        (total("portfolio_value") - total("bench_value")).alias("alpha"),
        F.when((n > 2) & (var > 1e-6), F.covar_samp("pr", "br") / F.nullif(var, F.lit(0.0))).otherwise(1.0).alias("beta"),
        F.when(n <= 5, -999.0).when(sd > 1e-4, sharpe_of("pr", rf)).otherwise(0.0).alias("sharpe"),
        (F.min("pdd") * 100).alias("portfolio_mdd"), (F.min("bdd") * 100).alias("bench_mdd"),
    )


def monthly_vs_benchmark(grid: DataFrame, initial: float, keys=("portfolio",)) -> DataFrame:
    from .aggregates import month_end_change

    m = month_end_change(grid, ["portfolio_value", "bench_value"], initial, keys)
    return m.select(
        *keys, "month", F.col("portfolio_value_change").alias("portfolio_return"),
        F.col("bench_value_change").alias("bench_return"),
        (F.col("portfolio_value_change") - F.col("bench_value_change")).alias("alpha"),
    )


ORDER_COLS = ["account", "symbol", "side", "qty", "price", "ts", "order_id"]


def _as_if_accepted(orders: DataFrame, initial: float) -> DataFrame:
    """Cash and shares before every order if all sound orders were accepted.

    Sums per hour, running sums over hours, and running sums inside the hour.
    """
    buy, sound = F.col("side") == "buy", F.col("qty") > 0
    cost = F.col("qty") * F.col("price")
    rows = (
        orders.select(*ORDER_COLS).withColumn("_h", F.date_trunc("hour", F.col("ts")))
        .withColumn("_dc", F.when(~sound, 0.0).when(buy, -cost).otherwise(cost))
        .withColumn("_dq", F.when(~sound, 0.0).when(buy, F.col("qty")).otherwise(-F.col("qty")))
    )
    for keys, delta, out in ((["account"], "_dc", "_cash"), (["account", "symbol"], "_dq", "_held")):
        upto = W.partitionBy(*keys).orderBy("_h").rowsBetween(W.unboundedPreceding, -1)
        hours = rows.groupBy(*keys, "_h").agg(F.sum(delta).alias("_s")).select(
            *keys, "_h", F.coalesce(F.sum("_s").over(upto), F.lit(0.0)).alias("_s0")
        )
        inside = W.partitionBy(*keys, "_h").orderBy("ts", "order_id").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.join(hours, [*keys, "_h"]).withColumn(
            out, F.col("_s0") + F.coalesce(F.sum(delta).over(inside), F.lit(0.0))
        ).drop("_s0")
    return rows.withColumn("_cash", F.col("_cash") + F.lit(float(initial)))


#: Orders of an account up to which they are walked in one go.
WALKED_ORDERS = 1_000_000


def validate_orders(orders: DataFrame, initial: float, walked: int = WALKED_ORDERS) -> DataFrame:
    """Adds `status` (ok, bad_qty, no_cash or no_shares) and `cash_after`.

    A rejected order moves neither cash nor shares. Orders move once: those of an account are walked in
    order, from batch to batch, without collecting them. An account of more than `walked` orders is settled up
    to the first order that would run it short (or come within rounding of it): all sound orders
    before it stand, and that part is settled with running sums, in parallel even inside one
    account. From there on the fate of an order depends on that of the ones before, so the rest of such an
    account is walked in sequence, from its cash and holdings at that point. Orders without account, symbol or
    time are dropped, but count in the cash up to the short order, those without time as the first ones.
    """
    orders = orders.select(*ORDER_COLS)
    large = orders.groupBy("account").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > walked).select("account")
    large = cut(large, "large-accounts")
    if large.isEmpty():
        return _walk_accounts(orders, initial)
    orders = cut(orders, "orders")
    settled, rest = settled_orders(orders.join(large, "account", "left_semi"), initial)
    few = _walk_accounts(orders.join(large, "account", "left_anti"), initial)
    # Written before it is dealt: the parts of a union may be taken for dealt alike when their shuffles are merged apart.
    return few.unionByName(settled).unionByName(_walk_orders(cut(rest, "rest")))


def _walk_accounts(orders: DataFrame, initial: float) -> DataFrame:
    schema = T.StructType([*orders.select(*ORDER_COLS).schema.fields, T.StructField("status", T.StringType()), T.StructField("cash_after", T.DoubleType())])

    # In here, so that it travels with the walk and no worker has to find this package.
    class Account:
        """Cash and shares, order by order: as `settled_orders` sums them up to the first short order, as `_walk_orders` decides from there on."""

        def __init__(self, initial: float):
            # Cash over all orders, and over those that are kept, from which an account goes on once it is short.
            self.cash, self.kept_cash, self.held, self.short = float(initial), float(initial), {}, False

        def _is_short(self, symbol, buy, qty, cost) -> bool:
            if buy:
                return cost is not None and self.cash < cost + 1e-6 + abs(cost) * 1e-9
            spare = self.held.get(symbol, 0.0) - qty
            return spare < 0 or 0 < spare < FLAT

        def order(self, kept, symbol, side, qty, price) -> tuple[str, float | None]:
            """status and cash_after; an order that is not kept only counts in the cash."""
            buy, sound = side == "buy", qty is not None and qty > 0
            cost = None if qty is None or price is None else qty * price
            if kept and not self.short and sound and self._is_short(symbol, buy, qty, cost):
                self.short, self.cash, self.held = True, self.kept_cash, {s: q for s, q in self.held.items() if q >= FLAT}
            if self.short:
                return self._decide(symbol, buy, sound, qty, math.nan if cost is None else cost) if kept else ("", None)
            if qty is not None and not sound:
                return "bad_qty", self.cash
            if kept and qty is not None:
                self.held[symbol] = self.held.get(symbol, 0.0) + (qty if buy else -qty)
            if cost is not None:
                self.cash += -cost if buy else cost
                self.kept_cash += (-cost if buy else cost) if kept else 0.0
            return "ok" if sound else "bad_qty", None if cost is None else self.cash

        def _decide(self, symbol, buy, sound, qty, cost) -> tuple[str, float | None]:
            status = "bad_qty"
            if sound and buy:
                status = "ok" if self.cash >= cost else "no_cash"
                if status == "ok":
                    self.cash -= cost
                    self.held[symbol] = self.held.get(symbol, 0.0) + qty
            elif sound:
                status = "ok" if self.held.get(symbol, 0.0) >= qty else "no_shares"
                if status == "ok":
                    self.cash += cost
                    self.held[symbol] -= qty
                    if self.held[symbol] < FLAT:
                        del self.held[symbol]
            return status, None if math.isnan(self.cash) else self.cash

    def walk(batches):
        account, at = None, None
        for batch in batches:
            names, symbols, sides = (batch.column(c).to_pylist() for c in ("account", "symbol", "side"))
            amounts = [batch.column(c).cast(pa.float64()).to_pylist() for c in ("qty", "price")]
            kept = pc.and_(batch.column("symbol").is_valid(), batch.column("ts").is_valid())
            done = []
            for a, *order in zip(names, kept.to_pylist(), symbols, sides, *amounts):
                if a != account:
                    account, at = a, Account(initial)
                done.append(at.order(*order))
            new = [pa.array([x[i] for x in done], kind) for i, kind in enumerate((pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names).filter(kept)

    known = orders.select(*ORDER_COLS).where(F.col("account").isNotNull())
    return known.repartition("account").sortWithinPartitions("account", "ts", "order_id").mapInArrow(walk, schema)


def settled_orders(orders: DataFrame, initial: float) -> tuple[DataFrame, DataFrame]:
    """Orders settled in parallel, and rows to walk: those from an account's first short order on.

    The latter begin with one row per symbol that the account holds at that point (side 'state',
    qty the shares) and one for its cash (symbol null, price the cash); `opening` marks both.
    """
    assumed = cut(_as_if_accepted(orders, initial), "assumed")
    cost = F.col("qty") * F.col("price")
    spare = F.col("_held") - F.col("qty")
    short = (F.col("qty") > 0) & F.when(
        F.col("side") == "buy", F.col("_cash") < cost + 1e-6 + F.abs(cost) * 1e-9
    ).otherwise((spare < 0) | ((spare > 0) & (spare < FLAT)))
    first = cut(assumed.where(short).groupBy("account").agg(F.min(F.struct("ts", "order_id")).alias("_first")), "short")
    marked = assumed.join(first, "account", "left").withColumn(
        "_rest", F.coalesce(F.struct("ts", "order_id") >= F.col("_first"), F.lit(False))
    )
    settled = marked.where(~F.col("_rest")).select(
        *ORDER_COLS, F.when(F.col("qty") > 0, "ok").otherwise("bad_qty").alias("status"),
        (F.col("_cash") + F.col("_dc")).alias("cash_after"),
    )
    types = {f.name: f.dataType for f in orders.schema.fields}
    before = marked.where(~F.col("_rest") & F.col("_first").isNotNull())
    shares = before.groupBy("account", "symbol").agg(F.sum("_dq").alias("_q")).where(F.col("_q") >= FLAT)
    cash = first.join(before.groupBy("account").agg(F.sum("_dc").alias("_c")), "account", "left")
    start = {"side": F.lit("state"), "qty": F.col("_q"), "symbol": F.lit(None), "price": F.lit(None), "ts": F.lit(None), "order_id": F.lit(None)}

    def opening(df: DataFrame, **known) -> DataFrame:
        values = {"account": F.col("account")} | start | known
        return df.select(*[values[c].cast(types[c]).alias(c) for c in ORDER_COLS], F.lit(True).alias("opening"))

    rest = marked.where("_rest").select(*ORDER_COLS, F.lit(False).alias("opening"))
    rest = rest.unionByName(opening(shares, symbol=F.col("symbol")))
    return settled, rest.unionByName(opening(cash, qty=F.lit(None), price=F.coalesce("_c", F.lit(0.0)) + float(initial)))


def _walk_orders(rows: DataFrame) -> DataFrame:
    rows = rows.select(*ORDER_COLS, "opening")
    fields = [f for f in rows.schema.fields if f.name != "opening"]
    schema = T.StructType([*fields, T.StructField("status", T.StringType()), T.StructField("cash_after", T.DoubleType())])

    def walk(batches):
        account, cash, held = None, 0.0, {}
        for pdf in batches:
            status, left = [], []
            for a, sym, side, qty, price, opening in zip(pdf.account, pdf.symbol, pdf.side, pdf.qty, pdf.price, pdf.opening):
                if a != account:
                    account, cash, held = a, 0.0, {}
                if opening:
                    if pd.notna(qty):
                        held[sym] = float(qty)
                    else:
                        cash = float(price)
                    continue
                cost = qty * price
                if not qty > 0:
                    s = "bad_qty"
                elif side == "buy":
                    s = "ok" if cash >= cost else "no_cash"
                    if s == "ok":
                        cash -= cost
                        held[sym] = held.get(sym, 0.0) + qty
                else:
                    s = "ok" if held.get(sym, 0.0) >= qty else "no_shares"
                    if s == "ok":
                        cash += cost
                        held[sym] -= qty
                        if held[sym] < FLAT:
                            del held[sym]
                status.append(s)
                left.append(cash)
            done = pdf[~pdf.opening].drop(columns="opening")
            yield done.assign(status=pd.Series(status, index=done.index, dtype=object), cash_after=pd.Series(left, index=done.index, dtype=float))

    ordered = rows.repartition("account").sortWithinPartitions("account", F.desc("opening"), "ts", "order_id")
    return ordered.mapInPandas(walk, schema)


def breaker_state(equity: DataFrame, limits: BreakerLimits = BreakerLimits(), key: str = "portfolio") -> DataFrame:
    """Status per row: OK, BREAKER_TRIPPED, BREAKER_ACTIVE or KILL_SWITCH.

    The kill switch is a running peak; the month clock of the breaker restarts
    from itself, so it is a fold over the dates of a portfolio.
    """
    state = "struct<hwm:double,kill:boolean,trip:date,mdate:date,mcap:double>"
    rows = equity.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("date", "capital"))).alias("rows"))

    def step(acc, r):
        hwm = F.greatest(F.coalesce(acc["hwm"], r["capital"]), r["capital"])
        dd = F.when(hwm > 0, (r["capital"] - hwm) / F.nullif(hwm, F.lit(0.0))).otherwise(0.0)
        kill = acc["kill"] | (dd <= limits.kill_drawdown)
        cooling = acc["trip"].isNotNull() & (F.datediff(r["date"], acc["trip"]) < limits.cooloff_days)
        due = acc["mdate"].isNotNull() & (F.datediff(r["date"], acc["mdate"]) >= limits.month_days)
        loss = due & truthy(div(r["capital"] - acc["mcap"], acc["mcap"]) < limits.month_loss)
        status = (
            F.when(kill, "KILL_SWITCH").when(cooling, "BREAKER_ACTIVE").when(loss, "BREAKER_TRIPPED").otherwise("OK")
        )
        frozen = kill | cooling
        restart = ~frozen & ~loss & (acc["mdate"].isNull() | due)
        trip = F.when(frozen, acc["trip"]).when(loss, r["date"])
        return F.struct(
            hwm.alias("hwm"), kill.alias("kill"), trip.alias("trip"),
            F.when(restart, r["date"]).otherwise(acc["mdate"]).alias("mdate"),
            F.when(restart, r["capital"]).otherwise(acc["mcap"]).alias("mcap"),
        ).cast(state), F.struct(r["date"].alias("date"), status.alias("status"))

    start = F.expr(
        f"cast(named_struct('hwm', null, 'kill', false, 'trip', null, 'mdate', null, 'mcap', null) as {state})"
    )
    out = fold(F.col("rows"), start, state, "struct<date:date,status:string>", step)
    return rows.select(key, F.explode(out).alias("o")).select(
        key, "o.date", "o.status"
    )


def per_strategy(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    return df.where(F.col("strategy").isin(*names))


def price_cache(ticks: DataFrame) -> DataFrame:
    """symbol, price, updated_at: last value per symbol, a partial aggregate."""
    return ticks.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "price")).alias("price"), F.max("ts").alias("updated_at"))
