"""Licence texts searched once, sliding means with a state per symbol, orders moved once, spreads held by month over bars written once."""

import datetime as dt
import random
import re
import subprocess
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from barloom.catalog import q_derivatives as Q
from barloom.llm import license_scan as L
from barloom.operators import derivatives as D
from barloom.operators import ledger as LE
from barloom.sources import adapters as A
from barloom.sources.scratch import scratch_dir
from barloom.streaming import jobs as ST
from barloom.streaming import operators as SO


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


FILES = [("a/LICENSE", "Released under the MIT License"), ("a/f1", "x\n// Licensed under the GNU Lesser General Public License, version 3\ny"), ("a/f2", "plain words"), ("b/COPYING", None), (None, None),
         ("b/f3", "This work is licensed under a Creative Commons\nAttribution 4.0 International License"), ("b/f3", "This work is licensed under a Creative Commons\nAttribution 4.0 International License")]


def test_texts_without_licence_are_searched_once(spark, monkeypatch):
    written = {}

    def note(df, name):
        written[name] = (optimized(df), df)
        return cut(df, name)

    cut = L.cut
    monkeypatch.setattr(L, "cut", note)
    files = spark.createDataFrame(FILES, "path string, text string")
    found = sorted(tuple(r) for r in L.stated(files).select("path", "licence", "line_no").collect())
    assert found == [("a/LICENSE", "MIT", 0), ("a/f1", "LGPL-3.0", 1), ("b/f3", "CC-BY-4.0", None)]
    # Texts without units are read in one place only, and the terms of a unit are split in one place.
    assert sum("text#" in plan and "LogicalRDD" in plan for plan, _ in written.values()) == 1
    assert sorted(str(r.path) for r in written["licence-texts"][1].select("path").distinct().collect()) == ["a/LICENSE", "a/f1", "b/COPYING", "b/f3"]
    assert written["licence-lines"][0].count(L.SEPARATORS) == 1


def streamed_mean(spark, parts, **spans):
    """All rows that the sliding mean gives batch by batch, the last per window, and the rows of its state."""
    schema = "symbol string, ts timestamp, x double"
    path, out = scratch_dir(spark, "ticks"), scratch_dir(spark, "means")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = SO.stream_sliding_mean(ST.read_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1), "x", **spans)
    q = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", scratch_dir(spark, "at")) \
        .foreachBatch(lambda df, i: df.withColumn("b", F.lit(i)).write.mode("append").parquet(out)).start()
    q.awaitTermination()
    best = spark.read.parquet(out).groupBy("symbol", "end").agg(F.max_by(F.struct("mean", "n"), "b").alias("m"))
    rows = sorted(((r.symbol, r.end, str(r.m.mean and round(r.m.mean, 9)), r.m.n) for r in best.collect()), key=str)
    return rows, max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators)


def test_a_symbol_has_one_row_of_state_and_every_window_its_mean(spark):
    rnd, first = random.Random(5), dt.datetime(2024, 1, 1)
    odd = lambda: rnd.choice([None, float("nan"), 5.0, -7.25, 900.0])
    # Nine batches whose times overlap by less than the delay, missing values, times and symbols, several ticks a step.
    parts = [[(rnd.choice(["A", "B", None]), first + dt.timedelta(hours=60 * k + rnd.randint(0, 70)), odd() if rnd.random() < 0.2 else rnd.random() * 100)
              for _ in range(30)] + [("A", None, 1.0)] for k in range(9)]
    for width, slide in (("20 days", "1 day"), ("36 hours", "1 day"), ("50 hours", "20 hours")):
        got, state = streamed_mean(spark, parts, width=width, slide=slide)
        every = spark.createDataFrame(sum(parts, []), "symbol string, ts timestamp, x double").groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
        assert got == sorted(((r.symbol, r.w.end, str(r.mean and round(r.mean, 9)), r.n) for r in every.collect()), key=str)
        assert state == 3


def test_a_late_tick_leaves_ended_windows_alone(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    got, _ = streamed_mean(spark, [[("A", day(n), float(n)) for n in range(10)], [("A", day(30), 30.0)], [("A", day(40), 40.0)], [("A", day(5), 1000.0)]], width="2 days", slide="1 day")
    assert ("A", day(6), "4.5", 2) in got and ("A", day(7), "5.5", 2) in got and ("A", day(41), "40.0", 1) in got


def odd_orders(spark):
    """Accounts that go short early, late and never, with several symbols, missing values, repeated orders and times."""
    rnd, rows = random.Random(2), []
    for account, most in (("rich", 3), ("mid", 60), ("poor", 400), (None, 5)):
        clock = dt.datetime(2024, 1, 1)
        for i in range(300):
            clock += dt.timedelta(seconds=rnd.randint(0, 900))
            odd = rnd.random() if account != "rich" or i > 200 else 1.0
            row = (account, None if odd < 0.02 else rnd.choice("XY"), None if 0.02 < odd < 0.04 else rnd.choice(["buy", "buy", "sell"]), None if 0.04 < odd < 0.06 else float(rnd.randint(-1, most)),
                   None if 0.06 < odd < 0.08 else rnd.random() * 5, None if 0.08 < odd < 0.1 else clock, f"{i:04d}")
            rows += [row] * (2 if i % 40 == 7 else 1)
    return spark.createDataFrame(rows, "account string, symbol string, side string, qty double, price double, ts timestamp_ntz, order_id string").repartition(5)


def test_walked_accounts_are_those_settled_by_sums(spark):
    o = odd_orders(spark)
    of = lambda **k: sorted(str((*r[:-1], None if r.cash_after is None else round(r.cash_after, 6))) for r in LE.validate_orders(o, 2000.0, **k).collect())
    settled, rest = LE.settled_orders(o, 2000.0)
    want = sorted(str((*r[:-1], None if r.cash_after is None else round(r.cash_after, 6))) for r in settled.unionByName(LE._walk_orders(rest)).collect())
    assert of() == of(walked=310) == of(walked=0) == want and len(want) > 700
    # Small batches, and joins without copies.
    for name, value, k in (("spark.sql.execution.arrow.maxRecordsPerBatch", 7, {}), ("spark.sql.autoBroadcastJoinThreshold", -1, {"walked": 0})):
        before = spark.conf.get(name)
        spark.conf.set(name, value)
        try:
            assert of(**k) == want
        finally:
            spark.conf.set(name, before)


def test_orders_move_once(spark):
    plan = LE.validate_orders(odd_orders(spark), 2000.0)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Window" not in plan and "Join" not in plan


def test_a_worker_needs_no_package_to_walk(spark, monkeypatch):
    o, sent = odd_orders(spark), []
    real = type(o).mapInArrow
    monkeypatch.setattr(type(o), "mapInArrow", lambda df, fn, schema, *a: sent.append(fn) or real(df, fn, schema, *a))
    LE.validate_orders(o, 2000.0)
    load = "import pickle, sys; pickle.loads(sys.stdin.buffer.read())"
    assert len(sent) == 1 and subprocess.run([sys.executable, "-c", load], input=cloudpickle.dumps(sent[0]), cwd="/", env={}, capture_output=True).returncode == 0


def test_lines_are_summed_up_to_bars_once(spark, sf, monkeypatch):
    plans = []

    def note(df, name):
        plans.append(optimized(df))
        return cut(df, name)

    cut = Q.cut
    for module in (Q, D):
        monkeypatch.setattr(module, "cut", note)
    for query in (Q._12, Q._14, Q._14b, Q._13):
        plans.clear()
        plans.append(optimized(query(spark, sf)))
        assert sum(plan.count("l_shipdate#") > 0 for plan in plans) == 1


def quoted(spark):
    """Quotes of two symbols over four months with gaps, repeated rows and missing values, and spreads over one to three months."""
    rnd, first, rows, spreads = random.Random(4), dt.date(2020, 1, 1), [], []
    expiries = [dt.date(2020, 1, 31), dt.date(2020, 2, 15), dt.date(2020, 4, 10)]
    for i in range(120):
        for symbol in "AB":
            if rnd.random() < 0.5:
                continue
            for x in expiries:
                for kind in ("CE", "PE"):
                    for strike in (10.0, 15.0, None):
                        row = (symbol, None if rnd.random() < 0.02 else first + dt.timedelta(days=i), None if rnd.random() < 0.02 else kind, x, strike, None if rnd.random() < 0.05 else rnd.random() * 9, 50)
                        rows += [row] * (2 if rnd.random() < 0.1 else 1)
            for x in expiries:
                day = first + dt.timedelta(days=i)
                spreads.append((symbol, day, rnd.choice(["CE", "PE"]), x, 10.0, rnd.choice([15.0, None, 15.0]), rnd.random() * 3, 50, rnd.randint(1, 3), 400.0))
    return (spark.createDataFrame(spreads + spreads[:3], "symbol string, date date, option_type string, expiry_dt date, atm_strike double, otm_strike double, net_debit double, lot_size int, lots int, max_profit_rs double"),
            spark.createDataFrame(rows, "symbol string, date date, option_type string, expiry_dt date, strike double, close double, lot_size int"))


def test_spreads_meet_their_quotes_by_month(spark):
    spreads, chain = quoted(spark)
    s = spreads.withColumnRenamed("date", "entry_date")
    leg = lambda name: chain.select("symbol", "option_type", "expiry_dt", F.col("strike").alias(f"{name}_strike"), "date", F.col("close").alias(name))
    held = s.join(leg("atm"), ["symbol", "option_type", "expiry_dt", "atm_strike"]).where("date > entry_date and date <= expiry_dt").join(leg("otm"), ["symbol", "option_type", "expiry_dt", "otm_strike", "date"])
    pnl = (F.col("atm") - F.col("otm") - F.col("net_debit")) * F.col("lot_size") * F.col("lots")
    keys = ["symbol", "entry_date", "option_type", "expiry_dt"]
    first = held.where(pnl >= 200.0).groupBy(*keys).agg(F.min("date").alias("exit_date"))
    want = sorted(map(str, s.join(first, keys, "left").select(*keys, "lots", "exit_date").collect()))
    dealt = chain.withColumn("month", F.trunc("date", "month")).repartition(7, "symbol", "month")
    for out in (D.take_profit_exit(spreads, chain), D.take_profit_exit(spreads, dealt, parts=7)):
        assert sorted(map(str, out.select(*keys, "lots", "exit_date").collect())) == want
    # The chain lies where it is, and a spread has a row per month.
    assert re.findall(r"Exchange hashpartitioning\((symbol#\d+, month#\d+, 7)", re.sub("L?,", ",", plan_of(out))) and "trunc(date_add" in plan_of(out)
    exits = [r for r in out.collect() if r.exit_date]
    assert exits and {r.exit_date.month - r.entry_date.month for r in exits} >= {0, 1}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_chain_by_month_is_the_chain(spark, sf):
    by_day, by_month = A.options(spark, sf), A.options(spark, sf, A.bars(spark, sf), "month")
    assert by_month.where("month <> trunc(date, 'month')").isEmpty()
    assert by_day.exceptAll(by_month.drop("month")).isEmpty() and by_month.drop("month").exceptAll(by_day).isEmpty()
