"""Streaming queries, each against the batch answer in SQL."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import clean as C
from ..operators import indicators as I
from ..operators import positions as PO
from ..operators import rank as K
from ..plans.screen import latest_rows
from ..sources import adapters as A
from ..sources.scratch import cut, scratch_dir
from ..streaming import jobs as J
from ..streaming import operators as S
from .base import BARS, PRICED, TRADES, query, r6, with_
from .q_clean import DIRTY, SEQ, dirty
from .q_ledger import AVG
from .q_portfolio import r


def events(s, d, files=None):
    schema = A.table(s, d, "events").schema
    ev = J.read_stream(s, d, schema, "events.parquet", files)
    return ev.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
                     F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id", "event_type")


def wall(df, *cols):
    """Event-time columns as wall-clock time."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def staged_in_order(s, df, name, parts=4):
    """df in parts whose dates rise from part to part, one part per micro-batch.

    A part has a file per split of df, so no task writes or reads a whole part.
    """
    path = scratch_dir(s, name)
    df = cut(df, f"{name}-whole")
    files = df.rdd.getNumPartitions() or 1
    lo, hi = df.agg(F.min("date"), F.max("date")).first()
    days = (hi - lo).days // parts + 1
    part = F.floor(F.datediff("date", F.lit(lo)) / days)
    for k in range(parts):
        df.where(part == k).repartition(files, "ticker").write.mode("append").parquet(path)
        # A share without rows has no file: empty ones keep the number, and so the batches, the same.
        for _ in range((k + 1) * files - len(s.read.schema(df.schema).parquet(path).inputFiles())):
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    return J.read_stream(s, path, df.schema, files_per_trigger=files)


def staged(s, df, name, parts=None):
    """A table written to the shared folder and read back as a file stream."""
    path = scratch_dir(s, name)
    (df if parts is None else df.repartition(parts)).write.parquet(path)
    return J.read_stream(s, path, df.schema)


def bar_ticks(s, d):
    b = A.bars(s, d)
    return b.select(F.col("ticker").alias("symbol"), F.col("date").cast("timestamp").alias("ts"), (F.col("close") * F.col("volume")).alias("turnover"), "close", "open")


_TK = "tk AS (SELECT 'U' || cast(user_id AS varchar) AS symbol, ts, value AS price, event_id, event_type FROM events)"


@query("st01_tumbling_bars", with_(_TK, body="""SELECT symbol, time_bucket(interval 5 minutes, ts) AS start, arg_min(price, row(ts, event_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, row(ts, event_id)) AS close, cast(count(*) AS double) AS volume FROM tk GROUP BY 1, 2"""))
def _1(s, d):
    return wall(J.drain_update(S.stream_bars(events(s, d)), ["symbol", "start"], "bars"), "start")


@query("st02_snapshots", with_(_TK, body="""SELECT event_type AS portfolio, time_bucket(interval 30 minutes, ts) AS start, arg_max(price, row(ts, event_id)) AS value FROM tk
  WHERE isodow(ts) <= 5 AND hour(ts) * 60 + minute(ts) BETWEEN 555 AND 930 GROUP BY 1, 2"""))
def _2(s, d):
    v = events(s, d).select(F.col("event_type").alias("portfolio"), "ts", F.col("price").alias("value"), "event_id")
    return wall(J.drain_update(S.stream_snapshots(v), ["portfolio", "start"], "snapshots"), "start")


@query("st03_last_price", with_(_TK, body="SELECT symbol, arg_max(price, row(ts, event_id)) AS price, max(ts) AS updated_at FROM tk GROUP BY 1"))
def _3(s, d):
    return wall(J.drain_update(S.stream_last_price(events(s, d)), ["symbol"], "last"), "updated_at")


@query("st04_validate", with_(BARS, DIRTY, SEQ, recursive=True, body="SELECT ticker, date, coalesce(reason, CASE WHEN jump THEN 'jump' END) AS reason FROM walk"))
def _4(s, d):
    out, _ = J.drain_append(S.stream_validate(staged_in_order(s, dirty(s, d), "candles")), "validated")
    return out.select("ticker", "date", "reason")


@query("st05_dedup", "SELECT event_id, value AS price FROM events")
def _5(s, d):
    """Every event arrives twice."""
    twice = events(s, d).withColumn("_c", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_c")
    out, _ = J.drain_append(S.stream_dedup(twice, ["event_id"]), "dedup")
    return out.select("event_id", "price")


@query("st06_positions", with_(PRICED, TRADES, AVG, recursive=True, body=f"""SELECT strategy, symbol, arg_max(q, i) AS qty, {r6('CASE WHEN arg_max(q, i) >= 0.000001 THEN arg_max(avg, i) ELSE 0 END', 5)} AS avg_cost, max(i) AS trades FROM wk GROUP BY 1, 2"""))
def _6(s, d):
    out = J.drain_update(S.stream_positions(staged(s, A.trades(s, d), "trades")), ["strategy", "symbol"], "positions")
    return r(out, "avg_cost", places=5)


@query("st07_sliding_mean", with_(BARS, body=f"""SELECT ticker AS symbol, e AS "end", {r6('avg(close * volume)', 4)} AS mean, count(*) AS n FROM (
  SELECT *, unnest(range(1, 21)) AS k FROM bars) b, LATERAL (SELECT date::timestamp + k * interval 1 day AS e) GROUP BY 1, 2"""))
def _7(s, d):
    m = S.stream_sliding_mean(staged(s, bar_ticks(s, d).select("symbol", "ts", "turnover"), "ticks"), "turnover")
    return wall(r(J.drain_update(m, ["symbol", "end"], "sliding", once=True), "mean", places=4), "end")


@query("st08_entry_bursts", with_(BARS, """en AS (SELECT ticker, date FROM bars WHERE close > open),
g AS (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY ticker ORDER BY date) <= 5 THEN 0 ELSE 1 END AS c FROM en),
h AS (SELECT *, sum(c) OVER (PARTITION BY ticker ORDER BY date) AS b FROM g),
z AS (SELECT ticker, b, min(date)::timestamp AS start, max(date)::timestamp + interval 5 days AS "end", count(*) AS entries FROM h GROUP BY 1, 2)""",
    body="""SELECT ticker, start, "end", entries FROM z WHERE "end" <= (SELECT max(date)::timestamp - interval 1 day FROM en)"""))
def _8(s, d):
    """A burst is final once the watermark has passed its end."""
    e = bar_ticks(s, d).where("close > open").select(F.col("symbol").alias("ticker"), "ts")
    return wall(J.drain_append(S.stream_entry_bursts(staged(s, e, "entries")), "bursts")[0], "start", "end")


@query("st09_late_rows")
def _9(s, d):
    """Events split into five files by id and read one file per batch, so most rows are late."""
    path = scratch_dir(s, "late")
    t = A.ticks(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    t.withColumn("part", F.col("event_id") % 5).repartition("part").write.partitionBy("part").parquet(path)
    stream = s.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    with J.logged_progress(s) as log:
        _, q = J.drain_append(S.stream_bars(stream), "late-bars")
        return log.table(s, q)


@query("st10_daily_pipeline", with_(BARS, DIRTY, SEQ, recursive=True, body=f"""SELECT ticker, count(*) AS accepted, max(date) AS last_date, {r6('arg_max(close, date)')} AS last_close FROM walk JOIN (SELECT ticker, date, close FROM dirty) USING (ticker, date)
  WHERE reason IS NULL AND NOT jump GROUP BY 1"""))
def _10(s, d):
    """Ingest of faulty bars in several batches: validate against the stored history, keep the accepted, latest state per ticker."""
    def accept(batch, stored):
        base = None if stored is None else stored.groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
        return C.split_rejects(C.validate_sequential(batch, base))[0]

    bars = J.run_daily(staged_in_order(s, dirty(s, d), "incoming"), [accept])
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("accepted"), F.max("date").alias("last_date"), rnd(F.max_by("close", "date")).alias("last_close"))


def daily_stages():
    """Ingest, rejects, exits, and two screens."""
    def judged(day):
        old = day.before("accepted")
        return C.split_rejects(C.validate_sequential(day["incoming"], None if old is None else old.groupBy("ticker").agg(F.max_by("close", "date").alias("close"))))

    def exits(day):
        """Every ticker is bought at its first accepted close and left once, at 10 % either way."""
        book = day.so_far("accepted").groupBy("ticker").agg(F.min("date").alias("entry_date"), F.min_by("close", "date").alias("entry_price"))
        book = book.withColumn("stop_loss", F.col("entry_price") * 0.9).withColumn("target", F.col("entry_price") * 1.1)
        gone = day.before("exits")
        if gone is not None:
            book = book.join(gone.select("ticker"), "ticker", "left_anti")
        latest = day["accepted"].groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
        return PO.stop_target_exits(book, latest).where("exit_reason IS NOT NULL").select("ticker", F.col("as_of").alias("date"), "exit_reason", "pnl_pct")

    def screen(n):
        def stage(day):
            now = latest_rows(I.ret_n(day.so_far("accepted"), n))
            return K.top_n(now, f"ret{n}", 10, part=()).select("ticker", "date", "rank", F.col(f"ret{n}").alias("ret"))

        return stage

    return {"accepted": lambda day: judged(day)[0], "rejects": lambda day: judged(day)[1], "exits": exits, "screen_month": screen(21), "screen_quarter": screen(63)}


@query("st11_daily_tables", with_(BARS, DIRTY, SEQ, f"""part AS (SELECT w.ticker, w.date, w.close, w.reason, w.jump, (w.date - lo) // ((hi - lo) // 4 + 1) AS batch
  FROM (SELECT ticker, date, reason, jump, (SELECT any_value(close) FROM dirty d WHERE d.ticker = walk.ticker AND d.date = walk.date) AS close FROM walk) w, (SELECT min(date) AS lo, max(date) AS hi FROM dirty)),
ab AS (SELECT *, close / lag(close, 21) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r21, close / lag(close, 63) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r63,
  first_value(close) OVER (PARTITION BY ticker ORDER BY date) AS e, first_value(date) OVER (PARTITION BY ticker ORDER BY date) AS ed FROM part WHERE reason IS NULL AND NOT jump),
la AS (SELECT batch, ticker, max(date) AS date, arg_max(close, date) AS close, any_value(e) AS e, any_value(ed) AS ed FROM ab GROUP BY ALL),
ex AS (SELECT *, CASE WHEN close <= e * 0.9::double THEN 'stop_loss' WHEN close >= e * 1.1::double THEN 'target' WHEN date - ed >= 60 THEN 'max_hold' END AS why FROM la),
nb AS (SELECT DISTINCT batch AS b FROM part),
sc AS (SELECT b, ticker, max(date) AS date, arg_max({{r21: r21, r63: r63}}, date) AS v FROM ab JOIN nb ON batch <= b GROUP BY ALL)""", recursive=True,
    body=f"""SELECT 'accepted' AS stage, batch::bigint AS batch, ticker, date, 'close' AS what, {r6('close')} AS value FROM ab
UNION ALL SELECT 'rejects', batch::bigint, ticker, date, coalesce(reason, 'jump'), NULL FROM part WHERE reason IS NOT NULL OR jump
UNION ALL SELECT 'exits', batch::bigint, ticker, date, why, {r6('(close / e - 1) * 100')} FROM (SELECT * FROM ex WHERE why IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY batch) = 1)
UNION ALL SELECT 'screen_month', b::bigint, ticker, date, rk::varchar, {r6('v.r21')} FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY v.r21 DESC, ticker) AS rk FROM sc WHERE v.r21 IS NOT NULL) WHERE rk <= 10
UNION ALL SELECT 'screen_quarter', b::bigint, ticker, date, rk::varchar, {r6('v.r63')} FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY v.r63 DESC, ticker) AS rk FROM sc WHERE v.r63 IS NOT NULL) WHERE rk <= 10"""))
def _11(s, d):
    """The daily job over faulty bars in four batches; the rows of all its tables."""
    out = scratch_dir(s, "daily-tables")
    J.run_daily_tables(staged_in_order(s, dirty(s, d), "incoming"), daily_stages(), out, scratch_dir(s, "daily-ckpt"))
    shown = {"accepted": (F.lit("close"), "close"), "rejects": (F.col("reason"), None), "exits": (F.col("exit_reason"), "pnl_pct"),
             "screen_month": (F.col("rank").cast("string"), "ret"), "screen_quarter": (F.col("rank").cast("string"), "ret")}
    rows = None
    for name, (what, value) in shown.items():
        part = J.committed_table(s, out, name).select(F.lit(name).alias("stage"), "batch", "ticker", "date", what.alias("what"),
                                                       (rnd(F.col(value)) if value else F.lit(None).cast("double")).alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows
