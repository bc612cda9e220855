"""Average cost walks trades once, barriers read series in place, quotes share what a bar has: same values as the plain rules."""

import datetime as dt
import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import ledger as L
from barloom.operators import positions as PO
from barloom.sources import adapters as A

TRADES = "strategy string, symbol string, side string, qty double, price double, ts timestamp_ntz, trade_id string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made(spark):
    """Symbols that go flat, missing sides, amounts, prices, times and symbols, repeated rows, several trades an hour."""
    rnd, rows = random.Random(3), []
    for symbol in ("X", "Y", "Z", None):
        clock, held = dt.datetime(2024, 1, 1), 0.0
        for i in range(300):
            clock += dt.timedelta(seconds=rnd.randint(1, 3000))
            sell = held > 0 and rnd.random() < 0.5
            qty = (held if rnd.random() < 0.2 else float(rnd.randint(1, int(held)))) if sell else float(rnd.randint(1, 40))
            held += -qty if sell else qty
            odd = rnd.random() if symbol == "Y" or i > 250 else 1.0
            row = ("A", symbol, None if odd < 0.02 else "sell" if sell else "buy", None if 0.02 < odd < 0.04 else qty,
                   None if 0.04 < odd < 0.06 else 50 + rnd.random() * 100, None if 0.06 < odd < 0.08 else clock, f"{i:04d}")
            rows += [row] * (2 if symbol == "Z" and i % 50 == 7 else 1)
    return spark.createDataFrame(rows, TRADES).repartition(5)


def near(got, want):
    got, want = (sorted(map(tuple, df.collect()), key=str) for df in (got, want))
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-7 * max(1, abs(y))) for x, y in zip(a, b)), (a, b)


def rounded(df):
    return df.select("strategy", "symbol", "trade_id", *[F.round(c, 6).alias(c) for c in ("qty_after", "avg_cost", "realised")])


def test_walk_and_hours_agree_on_odd_trades(spark):
    t = made(spark)
    near(rounded(L.average_cost(t)), rounded(L.average_cost(t, walked=0)))
    near(rounded(L.average_cost(t)), rounded(L.average_cost(t, walked=301)))
    near(L.open_positions(t), L.open_positions(t, walked=0))


def test_trades_move_once(spark):
    t = made(spark)
    for df in (L.average_cost(t), L.open_positions(t)):
        assert len(re.findall(r"Exchange hashpartitioning", plan(df))) == 1 and "Window" not in plan(df)


def test_a_walk_goes_on_from_batch_to_batch(spark):
    t = made(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        small = [L.average_cost(t), L.open_positions(t)]
        near(rounded(small[0]), rounded(L.average_cost(t, walked=0)))
        near(small[1], L.open_positions(t, walked=0))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_last_prices_break_ties_by_id(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("A", "X", "buy", 1.0, p, day, i) for p, i in ((5.0, "2"), (6.0, "3"), (7.0, "1"))] + [("B", "X", "buy", 1.0, 9.0, None, "9"), ("B", "Y", "buy", 1.0, 2.0, day, "1")]
    assert sorted(map(tuple, L.last_prices(spark.createDataFrame(rows, TRADES)).collect())) == [("X", 6.0), ("Y", 2.0)]


def later_rows(entries, bars, max_rows):
    """What a barrier reads, spelled out: the rows behind each entry, numbered."""
    numbered = bars.withColumn("_pos", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))
    at = entries.join(numbered.select("ticker", F.col("date").alias("entry_date"), F.col("_pos").alias("_at")), ["ticker", "entry_date"])
    return at.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(max_rows)))).withColumn("_pos", F.col("_at") + F.col("step")).join(numbered, ["ticker", "_pos"])


def series_with_entries(spark):
    rnd, day, bars, entries = random.Random(9), dt.date(2020, 1, 1), [], []
    for t in ("A", "B", "C", None):
        for i in range(120):
            close = 50 + rnd.random() * 10
            gap = lambda x: None if t == "B" and rnd.random() < 0.1 else x
            date = None if t == "C" and i == 0 else day + dt.timedelta(days=2 * i)
            bars.append((t, date, gap(close), gap(close - rnd.random()), gap(close + rnd.random()), gap(55.0 - 6 * (i % 3)), float("nan") if i == 40 else gap(1.0)))
            if i % 7 == 3 or i == 119:
                entries.append((t, date, gap(close), gap(float(rnd.randint(1, 9)))))
    entries += [("A", day + dt.timedelta(days=6), 40.0, 1.0), ("A", day + dt.timedelta(days=1), 50.0, 1.0), ("D", day, 50.0, 1.0), ("C", None, 50.0, 1.0), ("B", day, float("nan"), 1.0)]
    return (spark.createDataFrame(entries, "ticker string, entry_date date, entry_price double, atr double"),
            spark.createDataFrame(bars, "ticker string, date date, close double, low double, high double, kama double, atr_now double"))


def test_barriers_are_those_of_all_later_rows(spark):
    entries, bars = series_with_entries(spark)
    for max_rows in (1, 12, 500):
        reason = (F.when(F.col("low") <= F.col("entry_price") - 1.5 * F.col("atr"), "Stop Loss").when(F.col("high") >= F.col("entry_price") + 2.5 * F.col("atr"), "Target")
                  .when(F.coalesce(F.col("close") < F.col("kama") - 0.5 * F.col("atr_now"), F.lit(False)), "Trend Death").when(F.col("step") == max_rows, "Timeout"))
        hits = later_rows(entries, bars, max_rows).withColumn("reason", reason).where("reason is not null")
        # Of an entry that comes twice, with other bounds, the rule that stands first.
        rank = F.array_position(F.array(*map(F.lit, ("Stop Loss", "Target", "Trend Death", "Timeout"))), F.col("reason"))
        first = hits.groupBy("ticker", "entry_date").agg(F.min_by(F.struct("date", "reason", "close", "step"), F.struct("step", rank)).alias("x"))
        want = entries.join(first, ["ticker", "entry_date"], "left").select(*entries.columns, "x.date", "x.reason", "x.close", "x.step")
        got = PO.barrier_exits(entries, bars, max_rows=max_rows)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_no_row_after_an_entry_is_copied(spark):
    text = PO.barrier_exits(*series_with_entries(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in text and "FlatMapCoGroupsInArrow" in text


def test_what_quotes_share_is_worked_out_per_bar(spark, sf):
    plans = A.options(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "bround" not in plans[:plans.index("Generate")] and "last_day" not in plans[:plans.rindex("Generate")]
    q = A.options(spark, sf)
    assert q.count() == A.bars(spark, sf).count() * len(A.STRIKE_STEPS) * A.EXPIRIES * A.OPTION_TYPES
    atm = q.where("symbol = 'S0000000001'").groupBy("symbol", "date").agg(F.count_distinct("strike").alias("n"), F.count_distinct("expiry_dt").alias("e"), F.min("close").alias("c"))
    assert atm.where("n <> 9 or e not in (2, 3) or c <= 0").isEmpty() and not atm.isEmpty()
