"""Streams over several micro-batches against the batch operators."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import clean as C
from barloom.operators import ledger as L
from barloom.sources import adapters as A
from barloom.streaming import jobs as J
from barloom.streaming import operators as S


def by_year(spark, df, path):
    """One file per year, written in order, so batches arrive in order."""
    years = [r.y for r in df.select(F.year("date").alias("y")).distinct().orderBy("y").collect()]
    for y in years:
        df.where(F.year("date") == y).coalesce(1).write.mode("append").parquet(path)
    return J.read_stream(spark, path, df.schema, files_per_trigger=1)


def test_validation_carries_the_baseline_over_batches(spark, sf, tmp_path):
    from barloom.catalog.q_clean import dirty
    d = dirty(spark, sf)
    stream = by_year(spark, d, str(tmp_path / "candles"))
    out, q = J.drain_append(S.stream_validate(stream), "t-validate")
    assert len(q.recentProgress) > 3
    key = lambda df: sorted((r.ticker, r.date, r.reason or "") for r in df.select("ticker", "date", "reason").collect())
    assert key(out) == key(C.validate_sequential(d))


def test_positions_over_batches_equal_the_ledger(spark, sf, tmp_path):
    t = A.trades(spark, sf)
    out = J.drain_update(S.stream_positions(by_year(spark, t, str(tmp_path / "trades"))), ["strategy", "symbol"], "t-pos")
    got = {(r.strategy, r.symbol): (r.qty, round(r.avg_cost, 6)) for r in out.where("qty > 0").collect()}
    want = {(r.strategy, r.symbol): (r.qty, round(r.avg_cost, 6)) for r in L.open_positions(t).collect()}
    assert got == want


def test_redelivered_rows_are_dropped(spark, sf, tmp_path):
    ev = A.ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "ev")
    ev.coalesce(1).write.mode("append").parquet(path)
    ev.coalesce(1).write.mode("append").parquet(path)
    out, _ = J.drain_append(S.stream_dedup(J.read_stream(spark, path, ev.schema), ["event_id"]), "t-dedup")
    assert out.count() == ev.count()


def test_late_rows_are_counted(spark, sf, tmp_path):
    ev = A.ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "late")
    for p in range(3):
        ev.where(F.col("event_id") % 3 == p).coalesce(1).write.mode("append").parquet(path)
    with J.logged_progress(spark) as log:
        _, q = J.drain_append(S.stream_bars(J.read_stream(spark, path, ev.schema, files_per_trigger=1)), "t-late")
    assert log.table(spark, q).agg({"late_rows": "sum"}).first()[0] > 0


def _accept(batch, stored):
    base = None if stored is None else stored.groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
    return C.split_rejects(C.validate_sequential(batch, base))[0]


def _candles(spark, rows):
    df = spark.createDataFrame(rows, "ticker string, date string, close double").withColumn("date", F.to_date("date"))
    return df.select("ticker", "date", F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", F.lit(5.0).alias("volume"))


def test_daily_job_looks_back_and_resumes(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    first = _candles(spark, [("A", "2024-01-01", 10.0), ("B", "2024-01-01", 50.0)])
    run = lambda: J.run_daily(J.read_stream(spark, src, first.schema), [_accept], out=out, checkpoint=ckpt)
    first.write.mode("append").parquet(src)
    assert run().count() == 2
    assert run().count() == 2
    # Twice the last accepted close of an earlier run.
    _candles(spark, [("A", "2024-01-02", 20.0), ("B", "2024-01-02", 51.0)]).write.mode("append").parquet(src)
    assert sorted((r.ticker, r.close) for r in run().collect()) == [("A", 10.0), ("B", 50.0), ("B", 51.0)]


def test_daily_job_on_an_empty_source(spark, tmp_path):
    src = str(tmp_path / "none")
    empty = _candles(spark, [("A", "2024-01-01", 10.0)]).where("false")
    empty.write.parquet(src)
    assert J.run_daily(J.read_stream(spark, src, empty.schema), [_accept]).count() == 0


def test_stale_candles_are_rejected(spark, tmp_path):
    src = str(tmp_path / "stale")
    for day, close in (("2024-01-05", 10.0), ("2024-01-03", 10.5), ("2024-01-06", 11.0)):
        _candles(spark, [("A", day, close)]).coalesce(1).write.mode("append").parquet(src)
    schema = _candles(spark, [("A", "2024-01-01", 1.0)]).schema
    out, _ = J.drain_append(S.stream_validate(J.read_stream(spark, src, schema, files_per_trigger=1)), "stale")
    assert {str(r.date): r.reason for r in out.collect()} == {"2024-01-05": None, "2024-01-03": "stale", "2024-01-06": None}


def test_daily_tables_resume_between_two_stages(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    first = _candles(spark, [("A", "2024-01-01", 10.0), ("B", "2024-01-01", 50.0)])
    broken, runs = [True], []

    def second(day):
        if broken[0]:
            raise RuntimeError("stopped between two stages")
        runs.append("second")
        return day.so_far("one").groupBy("ticker").count()

    def one(day):
        runs.append("one")
        return day["incoming"].select("ticker", "close")

    run = lambda: J.run_daily_tables(J.read_stream(spark, src, first.schema), {"one": one, "two": second}, out, ckpt)
    first.write.mode("append").parquet(src)
    with pytest.raises(Exception, match="stopped between two stages"):
        run()
    assert J.committed_table(spark, out, "one") is None
    broken[0] = False
    assert run() == [0] and runs == ["one", "second"]
    assert run() == [0]
    _candles(spark, [("A", "2024-01-02", 11.0)]).write.mode("append").parquet(src)
    assert run() == [0, 1] and J.committed_table(spark, out, "one").count() == 3
    assert sorted((r.batch, r.ticker, r["count"]) for r in J.committed_table(spark, out, "two").collect()) == [(0, "A", 1), (0, "B", 1), (1, "A", 2), (1, "B", 1)]
