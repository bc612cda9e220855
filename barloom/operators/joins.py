"""Joins and set operations.

No broadcast hints: Catalyst and adaptive execution broadcast a side when its
measured size is below spark.sql.autoBroadcastJoinThreshold and shuffle it
otherwise, so a dimension that outgrows the bound changes the plan, not the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import keep_last


def join_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    return features.join(labels, ["date", "ticker"], "inner")


def join_market(strategy: DataFrame, market: DataFrame) -> DataFrame:
    """strategy (portfolio, date, ret) with market (date, mkt_ret), complete rows only."""
    return strategy.join(market, "date", "inner").dropna(subset=["ret", "mkt_ret"])


def attach_by_date(df: DataFrame, series: DataFrame) -> DataFrame:
    return df.join(series, "date", "left")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, default) -> DataFrame:
    """Attribute of a dimension; a miss gives the default."""
    out = df.join(dim.select(key, value), key, "left")
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str,
              fallback: dict | None = None, left_unique: bool = False) -> DataFrame:
    """Last right row with right.on <= left.on per key.

    Both sides are reduced to one row per (key, on) first, so the window sees at
    most two rows per calendar day and key; the answers are then joined back by
    equality, where adaptive execution can split a hot key.
    """
    values = [c for c in right.columns if c not in keys and c != on]
    payload = F.struct(*values)
    asks = left.select(*keys, on) if left_unique else left.select(*keys, on).distinct()
    # One value needs no struct, so the rows are hashed and not sorted.
    best = F.struct(F.max(values[0]).alias(values[0])) if len(values) == 1 else F.max(payload)
    facts = right.groupBy(*keys, on).agg(best.alias("_v"))
    both = asks.select(*keys, on, F.lit(None).alias("_v"), F.lit(1).alias("_ask")).unionByName(
        facts.select(*keys, on, "_v", F.lit(0).alias("_ask"))
    )
    w = W.partitionBy(*keys).orderBy(on, "_ask").rowsBetween(W.unboundedPreceding, 0)
    found = (
        both.withColumn("_v", F.last("_v", ignorenulls=True).over(w))
        .where(F.col("_ask") == 1)
        .select(*keys, on, *[F.col(f"_v.{c}").alias(c) for c in values])
    )
    out = left.join(found, [*keys, on], "left")
    for c, v in (fallback or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), v if isinstance(v, Column) else F.lit(v)))
    return out


def range_join(events: DataFrame, bars: DataFrame, lo: str, hi: str, key: str = "symbol") -> DataFrame:
    """Bars with lo < date <= hi per event.

    The equi part is (key, month): an event is spread over the months it covers,
    so one hot key becomes as many groups as it has months.
    """
    months = F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("interval 1 month"))
    ev = events.where(F.col(lo) <= F.col(hi)).withColumn("_m", F.explode(months))
    bm = bars.withColumn("_m", F.trunc("date", "month"))
    return ev.join(bm, [key, "_m"]).where(
        (F.col("date") > F.col(lo)) & (F.col("date") <= F.col(hi))
    ).drop("_m")


def alike(one: Column, two: Column) -> Column:
    """Equality that is tested on joined rows and is no key of the join, so it does not decide where rows lie."""
    return one.between(two, two)


def two_legs(signals: DataFrame, chain: DataFrame, lot: bool = True) -> DataFrame:
    """Both option legs of a spread on the signal date: atm_close, otm_close and, unless the signals have it, lot_size.

    Rows meet by (symbol, date): a chain that is dealt by these is not moved, and it streams past
    the hashed signals, so the larger side is never sorted either. A day of a symbol has few signals.
    """
    for leg, more in (("atm", ["lot_size"] if lot else []), ("otm", [])):
        c = chain.select("symbol", "date", F.col("option_type").alias("_type"), F.col("expiry_dt").alias("_expiry"),
                         F.col("strike").alias("_strike"), F.col("close").alias(f"{leg}_close"), *more)
        met = signals.hint("shuffle_hash").join(c, ["symbol", "date"]).where(
            alike(F.col("_type"), F.col("option_type")) & alike(F.col("_expiry"), F.col("expiry_dt"))
            & alike(F.col("_strike"), F.col(f"{leg}_strike")))
        signals = met.drop("_type", "_expiry", "_strike")
    return signals


def pair_series(bars: DataFrame, pairs: DataFrame, min_rows: int = 200, last: int | None = 252) -> DataFrame:
    """pair_id, leg1, leg2, date, p1, p2 on the common dates of the last rows of each leg; pairs with fewer are dropped."""
    px = bars.select("ticker", "date", "close")
    if last is not None:
        recent = W.partitionBy("ticker").orderBy(F.col("date").desc())
        px = px.withColumn("_rn", F.row_number().over(recent)).where(F.col("_rn") <= last).drop("_rn")
    a = pairs.join(px.select(F.col("ticker").alias("leg1"), "date", F.col("close").alias("p1")), "leg1")
    both = a.join(px.select(F.col("ticker").alias("leg2"), "date", F.col("close").alias("p2")),
                  ["leg2", "date"])
    w = W.partitionBy("pair_id")
    return (
        both.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= min_rows)
        .select("pair_id", "leg1", "leg2", "date", "p1", "p2")
    )


def semi(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, keys.columns, "left_semi")


def anti(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, keys.columns, "left_anti")


def outer_weights(old: DataFrame, new: DataFrame, keys=("ticker",)) -> DataFrame:
    """old_weight and new_weight per key, zero where one side is missing."""
    o = old.withColumnRenamed("weight", "old_weight")
    n = new.withColumnRenamed("weight", "new_weight")
    return o.join(n, list(keys), "full_outer").fillna({"old_weight": 0.0, "new_weight": 0.0})


def on_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every grid row, values where they exist."""
    return grid.join(df, grid.columns, "left")


def cross_configs(df: DataFrame, grid: list[dict]) -> DataFrame:
    """Every row with every configuration.

    The grid is a literal of the plan (a parameter list, not data), exploded in
    place: no join and no shuffle.
    """
    cells = [F.struct(*[F.lit(v).alias(k) for k, v in cfg.items()]) for cfg in grid]
    return df.select("*", F.inline(F.array(*cells)))


def nearest_expiry_leg(chain: DataFrame) -> DataFrame:
    """Per symbol, date, strike and type the row of the nearest expiry."""
    keys = ["symbol", "date", "strike", "option_type"]
    return chain.groupBy(*keys).agg(
        F.min("expiry_dt").alias("expiry_dt"),
        F.min_by("close", "expiry_dt").alias("close"),
        F.min_by("lot_size", "expiry_dt").alias("lot_size"),
    )


def trade_sets(old: DataFrame, new: DataFrame, keys=("ticker",)) -> DataFrame:
    """sell / buy / hold from two holdings tables."""
    o = old.select(*keys, F.lit(True).alias("_o"))
    n = new.select(*keys, F.lit(True).alias("_n"))
    return o.join(n, list(keys), "full_outer").select(
        *keys,
        F.when(F.col("_n").isNull(), "sell").when(F.col("_o").isNull(), "buy").otherwise("hold").alias("action"),
    )


def union_dedup(dfs: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in order; the last piece wins on a repeated key."""
    out = dfs[0].withColumn("_src", F.lit(0))
    for i, d in enumerate(dfs[1:], 1):
        out = out.unionByName(d.withColumn("_src", F.lit(i)))
    return keep_last(out, keys, ["_src"]).drop("_src")


def distinct_of(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()
