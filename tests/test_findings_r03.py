"""Large sides that stay where they lie, joins without copies in the driver, parts of a stream in several files."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from barloom.catalog import q_joins, q_streaming
from barloom.llm import chosen_path
from barloom.operators import derivatives as D
from barloom.operators import joins as J
from barloom.sources.scratch import cut


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_quotes_are_not_moved(spark, sf):
    for df in (q_joins._j7(spark, sf), q_joins._j13(spark, sf)):
        moved = re.findall(r"Exchange hashpartitioning\((.*)", plan(df))
        assert moved and not [m for m in moved if "strike" in m or "option_type" in m]


def test_two_legs_keep_repeated_rows_and_lose_null_keys(spark):
    d = dt.date(2020, 1, 2)
    chain = spark.createDataFrame([("A", d, "CE", d, 10.0, 3.0, 50), ("A", d, "CE", d, 10.0, 4.0, 50), ("A", d, "CE", d, 11.0, 1.0, 50), ("A", d, None, d, 10.0, 9.0, 50)],
                                  "symbol string, date date, option_type string, expiry_dt date, strike double, close double, lot_size int")
    signals = spark.createDataFrame([("A", d, "CE", d, 10.0, 11.0), ("A", d, None, d, 10.0, 11.0), ("A", d, "CE", d, 10.0, None)],
                                    "symbol string, date date, option_type string, expiry_dt date, atm_strike double, otm_strike double")
    got = sorted((r.atm_close, r.otm_close, r.lot_size) for r in J.two_legs(signals, chain).collect())
    assert got == [(3.0, 1.0, 50), (4.0, 1.0, 50)]


def test_take_profit_without_moving_the_chain(spark):
    e, x = dt.date(2020, 1, 2), dt.date(2020, 1, 31)
    day = lambda n: dt.date(2020, 1, n)
    quotes = [("A", day(2), 9.0, 0.0), ("A", day(5), 3.0, 1.0), ("A", day(9), 8.0, 1.0), ("A", day(20), 9.0, 1.0), ("A", dt.date(2020, 2, 3), 9.0, 0.0)]
    chain = spark.createDataFrame([r for s, d, a, o in quotes for r in ((s, d, "CE", x, 10.0, a, 50), (s, d, "CE", x, 15.0, o, 50))],
                                  "symbol string, date date, option_type string, expiry_dt date, strike double, close double, lot_size int").repartition(7, "symbol", "date")
    spreads = spark.createDataFrame([("A", e, "CE", x, 10.0, 15.0, 2.0, 50, 1, 150.0), ("B", e, "CE", x, 10.0, 15.0, 2.0, 50, 1, 150.0)],
                                    "symbol string, date date, option_type string, expiry_dt date, atm_strike double, otm_strike double, net_debit double, lot_size int, lots int, max_profit_rs double")
    out = D.take_profit_exit(spreads, chain, parts=7)
    assert sorted((r.symbol, r.exit_date, r.exit_pnl, r.exit_premium) for r in out.collect()) == [("A", day(9), 250.0, 7.0), ("B", None, None, None)]
    assert not [m for m in re.findall(r"Exchange hashpartitioning\((.*)", plan(out)) if "strike" in m]


def test_joins_of_growing_tables_make_no_copy_in_the_driver(spark):
    a = spark.range(50).select(F.col("id").alias("key"))
    df = chosen_path.met(a, a.where("key > 3"), "key")
    assert df.count() == 46 and "Broadcast" not in plan(df)


@pytest.mark.parametrize("tickers", [1, 100])
def test_a_part_of_a_stream_has_a_file_per_split(spark, tickers):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 40).cast("int"))
    df = spark.range(4000).select(F.concat(F.lit("T"), (F.col("id") / 40 % tickers).cast("int").cast("string")).alias("ticker"), day.alias("date")).repartition(6)
    files = cut(df, "splits").rdd.getNumPartitions()
    assert files > 1
    stream = q_streaming.staged_in_order(spark, df, "parts")
    seen = []

    def note(batch, i):
        rows = batch.select("date", F.input_file_name().alias("file"))
        seen.append(tuple(rows.agg(F.min("date"), F.max("date"), F.count(F.lit(1)), F.count_distinct("file")).first()))

    stream.writeStream.foreachBatch(note).trigger(availableNow=True).option("checkpointLocation", cut(df.limit(1), "at").inputFiles()[0] + "-ckpt").start().awaitTermination()
    first = dt.date(2020, 1, 1)
    # One ticker fills one file; the others of a part are empty and keep the batches apart.
    assert [s[:3] for s in seen] == [(first + dt.timedelta(10 * k), first + dt.timedelta(10 * k + 9), 1000) for k in range(4)]
    assert [s[3] for s in seen] == [min(files, tickers)] * 4
