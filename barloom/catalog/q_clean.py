"""Sources, ingest and cleaning."""


from pyspark.sql import functions as F

from ..functions.columns import add_suffix, clean_number, div, normalise_date, parse_date_any, rnd, strip_suffix
from ..operators import clean as C
from ..operators import indicators as I
from ..functions.windows import rolling
from ..sources import adapters as A
from ..sources import tables as S
from ..sources.scratch import scratch_dir
from .base import BARS, MEMBERS, PRICED, TRADES, frame, key_sql, lagx, over, query, r6, ret_sql, roll, run, with_

COLS = ["ticker", "date", "open", "high", "low", "close", "volume"]
_CUT = "date '2000-01-01'"


def before(df, day):
    return df.where(F.col("date") < F.lit(day).cast("date"))


def since(df, day):
    return df.where(F.col("date") >= F.lit(day).cast("date"))


def dirty(s, d):
    """Bars with every kind of fault, placed by ticker number and day."""
    h = (F.substring("ticker", 2, 10).cast("long") * 31
         + F.datediff("date", F.lit("1995-01-01").cast("date"))) % 50
    b = A.bars(s, d).withColumn("h", h)
    pick = lambda i, v, c: F.when(F.col("h") == i, v).otherwise(F.col(c))
    return b.select(
        "ticker", "date", "open",
        F.when(F.col("h") == 2, F.col("low") - 1).when(F.col("h") == 3, F.col("close") * 0.9)
        .when(F.col("h") == 5, F.col("close") * 2).otherwise(F.col("high")).alias("high"),
        pick(4, F.col("close") * 1.1, "low").alias("low"),
        F.when(F.col("h") == 0, F.lit(0.5)).when(F.col("h") == 5, F.col("close") * 1.4)
        .otherwise(F.col("close")).alias("close"),
        pick(1, F.lit(0.0), "volume").alias("volume"),
    )


DIRTY = """dirty AS MATERIALIZED (SELECT ticker, date, open,
  CASE WHEN h = 2 THEN low - 1 WHEN h = 3 THEN close * 0.9::double WHEN h = 5 THEN close * 2 ELSE high END AS high,
  CASE WHEN h = 4 THEN close * 1.1::double ELSE low END AS low,
  CASE WHEN h = 0 THEN 0.5::double WHEN h = 5 THEN close * 1.4::double ELSE close END AS close,
  CASE WHEN h = 1 THEN 0.0::double ELSE volume END AS volume
  FROM (SELECT *, (cast(substring(ticker, 2, 10) AS bigint) * 31 + (date - date '1995-01-01')) % 50 AS h FROM bars))"""

REASON = """CASE WHEN close < 1 THEN 'close_below_one' WHEN volume = 0 THEN 'no_volume'
  WHEN high < low THEN 'high_below_low' WHEN high < open OR high < close THEN 'high_below_body'
  WHEN low > open OR low > close THEN 'low_above_body' END"""


def bar_cols(df):
    return df.select("ticker", "date", *[rnd(c).alias(c) for c in COLS[2:]])


BAR_SEL = "ticker, date, " + ", ".join(f"{r6(c)} AS {c}" for c in COLS[2:])


@query("src01_bar_scan", with_(BARS, body=f"SELECT {BAR_SEL} FROM bars"))
def _scan(s, d):
    """Bars written to the shared folder by year and read back with the declared schema."""
    path = scratch_dir(s, "bars")
    S.write_bars(A.bars(s, d), path)
    return bar_cols(S.read_bars(s, path))


@query("src02_last_close", with_(BARS, body=f"""SELECT ticker, {r6('arg_max(close, date)')} AS close, max(date) AS date
  FROM bars WHERE ticker = 'S0000000007' GROUP BY ticker"""))
def _last(s, d):
    return S.last_close(A.bars(s, d), "S0000000007").withColumn("close", rnd("close"))


@query("src03_latest_slice", with_(BARS, MEMBERS, body=f"""SELECT {BAR_SEL} FROM bars
  WHERE date = (SELECT max(date) FROM bars) AND ticker IN (SELECT ticker FROM members)"""))
def _slice(s, d):
    return bar_cols(S.latest_slice(A.bars(s, d), A.universe(s, d)))


@query("src04_csv_dimension", f"""SELECT {key_sql('S', 's_suppkey')} AS symbol, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _dim(s, d):
    from ..schemas import SECTOR_MAP
    path = scratch_dir(s, "dim")
    S.write_csv(A.sector_map(s, d).withColumnRenamed("ticker", "symbol"), path)
    return S.read_dim(s, path, SECTOR_MAP)


_DEFAULTED = f"""SELECT {key_sql('S', 's_suppkey')} AS ticker,
  coalesce(CASE WHEN s_suppkey % 29 <> 0 THEN cast(s_suppkey % 25 + 5 AS double) END, 999) AS roe,
  999.0::double AS icr_default, s_suppkey % 23 = 0 AS auditor_flag FROM supplier"""


@query("src05_csv_fundamentals", _DEFAULTED)
def _fund(s, d):
    from ..schemas import FUNDAMENTALS
    path = scratch_dir(s, "fundamentals")
    full = A.fundamentals(s, d)
    for f in FUNDAMENTALS.fields:
        if f.name not in full.columns:
            full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
    S.write_csv(full.withColumn("icr", F.lit(None).cast("double")).select(*FUNDAMENTALS.names), path)
    return S.read_fundamentals(s, path).select("ticker", "roe", F.col("icr").alias("icr_default"), "auditor_flag")


def _document(s, d):
    from ..plans.screen import screen_document
    from ..schemas import ScreenParams
    return screen_document(A.bars(s, d), A.sector_map(s, d), min_turnover=20000.0,
                           params=ScreenParams(bear_momentum=0.0))


@query("src06_held_from_signals")
def _held(s, d):
    path = scratch_dir(s, "signals")
    S.write_signals(_document(s, d), path)
    return S.held_from_signals(S.read_signals(s, path))


@query("src07_signals_document")
def _doc(s, d):
    path = scratch_dir(s, "signals")
    S.write_signals(_document(s, d), path)
    doc = S.read_signals(s, path)
    rows = doc.select("regime", "portfolio_value", F.size("sector_stats").cast("long").alias("n_sectors"), F.posexplode("signals").alias("place", "x"))
    return rows.select("regime", "portfolio_value", "n_sectors", (F.col("place") + 1).cast("long").alias("slot"), "x.ticker", "x.sector", "x.signal", rnd("x.price").alias("price"))


@query("src08_ledger_tables", with_(
    PRICED, TRADES, body=f"""SELECT strategy, symbol, side, count(*) AS n,
  {r6('sum(qty)')} AS qty, {r6('sum(qty * price)', 2)} AS notional FROM trades GROUP BY 1, 2, 3"""))
def _ledger(s, d):
    root = scratch_dir(s, "ledger")
    S.write_ledger(A.trades(s, d), root, "trades")
    return S.read_ledger(s, root, "trades").groupBy("strategy", "symbol", "side").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("qty")).alias("qty"),
        rnd(F.sum(F.col("qty") * F.col("price")), 2).alias("notional"))


@query("src09_csv_sink", with_(BARS, body="SELECT ticker, date, volume FROM bars"))
def _csv(s, d):
    from ..schemas import schema
    path = scratch_dir(s, "csv")
    S.write_csv(A.bars(s, d).select("ticker", "date", "volume"), path)
    return S.read_dim(s, path, schema(ticker="string", date="date", volume="double"))


@query("src10_mixed_dates", """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p,
  CASE WHEN l_orderkey % 4 = 3 THEN NULL ELSE cast(l_shipdate AS date) END AS d FROM lineitem""")
def _dates(s, d):
    day = F.col("l_shipdate")
    text = (F.when(F.col("l_orderkey") % 4 == 0, F.date_format(day, "yyyy-MM-dd"))
            .when(F.col("l_orderkey") % 4 == 1, F.date_format(day, "dd-MMM-yyyy"))
            .when(F.col("l_orderkey") % 4 == 2, F.date_format(day, "dd/MM/yyyy")).otherwise(F.lit("n/a")))
    li = A.table(s, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
                     parse_date_any(text, ("yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy")).alias("d"))


@query("src11_ticker_suffix", f"""SELECT {key_sql('S', 's_suppkey')} AS plain,
  {key_sql('S', 's_suppkey')} || '.NS' AS suffixed FROM supplier""")
def _suffix(s, d):
    t = A.table(s, d, "supplier").select(A.ticker_of("s_suppkey").alias("t"))
    sfx = add_suffix(add_suffix("t", ".NS"), ".NS")
    return t.select(strip_suffix(sfx, ".NS").alias("plain"), sfx.alias("suffixed"))


@query("src12_trade_journal", with_(BARS, body=f"""SELECT ticker, min(date) AS entry_date, max(date) AS exit_date,
  {r6('arg_min(close, date)')} AS entry_price, {r6('arg_max(close, date)')} AS exit_price, 'Target' AS reason
  FROM bars GROUP BY ticker"""))
def _journal(s, d):
    from ..schemas import JOURNAL
    path = scratch_dir(s, "journal")
    j = A.bars(s, d).groupBy("ticker").agg(
        F.min("date").alias("entry_date"), F.max("date").alias("exit_date"),
        rnd(F.min_by("close", "date")).alias("entry_price"), rnd(F.max_by("close", "date")).alias("exit_price"))
    for f in JOURNAL.fields:
        if f.name not in j.columns:
            j = j.withColumn(f.name, F.lit("Target") if f.name == "reason" else F.lit(None).cast(f.dataType))
    S.write_csv(j.select(*JOURNAL.names), path)
    return S.read_journal(s, path).select("ticker", "entry_date", "exit_date", "entry_price", "exit_price", "reason")


@query("ing01_high_water_mark", with_(BARS, body=f"""SELECT {BAR_SEL} FROM bars WHERE date >= date '1999-12-01'
  AND date > (SELECT max(date) FROM bars WHERE date < {_CUT})"""))
def _hwm(s, d):
    b = A.bars(s, d)
    return bar_cols(C.newer_than_stored(since(b, "1999-12-01"), before(b, "2000-01-01")))


@query("ing02_index_drift", with_(BARS, MEMBERS, body="""SELECT DISTINCT ticker FROM members
  WHERE ticker NOT IN (SELECT ticker FROM bars)"""))
def _drift(s, d):
    return C.index_drift(A.universe(s, d), A.bars(s, d))


@query("ing03_candle_reason", with_(BARS, DIRTY, body=f"SELECT ticker, date, {REASON} AS reason FROM dirty"))
def _candle(s, d):
    return C.candle_reason(dirty(s, d)).select("ticker", "date", "reason")


SEQ = f"""seq AS MATERIALIZED (SELECT ticker, date, close, {REASON} AS reason, row_number() OVER {over()} AS rn FROM dirty),
walk AS (
  SELECT ticker, date, rn, reason, false AS jump, cast(NULL AS double) AS baseline,
    CASE WHEN reason IS NULL THEN close END AS base FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.ticker, s.date, s.rn, s.reason, coalesce(abs(s.close / w.base - 1) > 0.25, false), w.base,
    CASE WHEN s.reason IS NULL AND NOT coalesce(abs(s.close / w.base - 1) > 0.25, false) THEN s.close ELSE w.base END
  FROM walk w JOIN seq s ON s.ticker = w.ticker AND s.rn = w.rn + 1)"""


@query("ing04_validate_sequential", with_(BARS, DIRTY, SEQ, recursive=True, body=f"""SELECT ticker, date,
  coalesce(reason, CASE WHEN jump THEN 'jump' END) AS reason, {r6('baseline')} AS baseline FROM walk"""))
def _validate(s, d):
    return C.validate_sequential(dirty(s, d)).select("ticker", "date", "reason", rnd("baseline").alias("baseline"))


@query("ing05_jump_flag", with_(BARS, DIRTY, body=f"""SELECT ticker, date,
  coalesce(abs(close / nullif({lagx('close')}, 0) - 1) > 0.25, false) AS jump FROM dirty"""))
def _jump(s, d):
    return C.jump_flag(dirty(s, d)).select("ticker", "date", "jump")


@query("ing06_rejects", with_(BARS, DIRTY, SEQ, recursive=True, body="""SELECT ticker, date,
  coalesce(reason, 'jump') AS reason, ticker || ' on ' || cast(date AS varchar) || ': ' || coalesce(reason, 'jump') AS head
  FROM walk WHERE reason IS NOT NULL OR jump"""))
def _rejects(s, d):
    bad = C.split_rejects(C.validate_sequential(dirty(s, d)))[1]
    return bad.select("ticker", "date", "reason", F.regexp_extract("message", r"^(.*) \(close", 1).alias("head"))


@query("ing07_keep_last", """SELECT o_custkey, day, arg_max(o_totalprice, o_orderkey) AS o_totalprice,
  max(o_orderkey) AS o_orderkey FROM (SELECT *, cast(o_orderdate AS date) AS day FROM orders) GROUP BY 1, 2""")
def _keep(s, d):
    o = A.table(s, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderkey")
    return C.keep_last(o, ["o_custkey", "day"], ["o_orderkey"])


_MERGED = f"""m AS (SELECT *, 0 AS src FROM bars WHERE date < {_CUT} UNION ALL
  SELECT ticker, date, open, high, low, close * 1.01::double, volume, 1 FROM bars WHERE date >= date '1999-12-01'),
mk AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY src DESC) = 1)"""


def _stored_new(s, d):
    b = A.bars(s, d)
    return before(b, "2000-01-01"), since(b, "1999-12-01").withColumn("close", F.col("close") * 1.01)


@query("ing08_merge_bars", with_(BARS, _MERGED, body=f"SELECT {BAR_SEL} FROM mk"))
def _merge(s, d):
    return bar_cols(C.merge_bars(*_stored_new(s, d)))


@query("ing08_added_rows", with_(BARS, body=f"""SELECT count(*) FILTER (date < {_CUT}) AS stored,
  count(*) FILTER (date >= date '1999-12-01') AS incoming, count(*) FILTER (date >= {_CUT}) AS added FROM bars"""))
def _added(s, d):
    return C.added_rows(*_stored_new(s, d))


_DIRTYSET = "(SELECT ticker FROM sectors WHERE sector = 'ASIA')"


@query("ing09_replace_tickers", None)
def _replace(s, d):
    old, new = _stored_new(s, d)
    t = A.sector_map(s, d).where("sector = 'ASIA'").select("ticker")
    return bar_cols(C.replace_tickers(old, new, t))


from .base import ORACLES, SECTORS  # noqa: E402

ORACLES["ing09_replace_tickers"] = with_(BARS, SECTORS, body=f"""SELECT {BAR_SEL} FROM (
  SELECT * FROM bars WHERE date < {_CUT} AND ticker NOT IN {_DIRTYSET} UNION ALL
  SELECT ticker, date, open, high, low, close * 1.01::double, volume FROM bars
  WHERE date >= date '1999-12-01' AND ticker IN {_DIRTYSET})""")


@query("ing10_flat_series", with_(BARS, body=f"""SELECT ticker, {r6('stddev_samp(close)')} AS std_close FROM bars
  WHERE year(date) = 1998 GROUP BY ticker HAVING stddev_samp(close) < 45"""))
def _flat(s, d):
    return C.flat_series(A.bars(s, d), 1998, 45.0).withColumn("std_close", rnd("std_close"))


@query("ing11_stitch_history", with_(BARS, f"""legacy AS (SELECT ticker, date, close * 0.5::double AS close FROM bars WHERE date < date '1999-06-01'),
cur AS (SELECT ticker, date, close FROM bars WHERE date >= date '1998-06-01' AND ticker <> 'S0000000003'),
facts AS (SELECT ticker, min(date) AS f, coalesce(stddev_samp(close) < 50, false) AS flat FROM cur GROUP BY ticker)""",
    body=f"""SELECT ticker, date, {r6('close')} AS close FROM (
  SELECT l.ticker, l.date, l.close FROM legacy l LEFT JOIN facts USING (ticker) WHERE f IS NULL OR flat OR date < f
  UNION ALL SELECT c.ticker, c.date, c.close FROM cur c JOIN facts USING (ticker)
  WHERE NOT flat OR ticker NOT IN (SELECT ticker FROM legacy))"""))
def _stitch(s, d):
    b = A.bars(s, d).select("ticker", "date", "close")
    legacy = before(b, "1999-06-01").withColumn("close", F.col("close") * 0.5)
    cur = since(b, "1998-06-01").where("ticker <> 'S0000000003'")
    return C.stitch_history(legacy, cur, min_std=50.0).withColumn("close", rnd("close"))


@query("ing12_frozen_by_year", with_(BARS, body=f"""SELECT ticker, cast(year(date) AS int) AS year,
  {r6('stddev_samp(close) / avg(close)')} AS cv FROM bars GROUP BY 1, 2 HAVING stddev_samp(close) / avg(close) < 0.05"""))
def _frozen(s, d):
    return C.frozen_by_year(A.bars(s, d), 0.05).withColumn("cv", rnd("cv"))


@query("ing13_valid_candles", with_(BARS, DIRTY, body=f"""SELECT {BAR_SEL} FROM dirty
  WHERE high >= greatest(open, close) AND low <= least(open, close)"""))
def _valid(s, d):
    return bar_cols(C.valid_candles(dirty(s, d)))


@query("ing14_coerce_numeric", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0""")
def _coerce(s, d):
    o = A.table(s, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "-").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"))
    return C.coerce_numeric(o, ["o_totalprice"])


_GRID = """grid AS (SELECT t.ticker, c.date FROM (SELECT DISTINCT ticker FROM bars) t, (
  SELECT max(date) AS date FROM bars GROUP BY date_trunc('month', date)) c),
gb AS (SELECT g.ticker, g.date, b.close FROM grid g LEFT JOIN bars b ON b.ticker = g.ticker AND b.date = g.date)"""


def month_grid(s, d):
    """Every ticker on every month end; the months of the table are exploded per ticker."""
    from ..operators.calendar import month_end_dates
    b = A.bars(s, d)
    days = month_end_dates(b).agg(F.array_sort(F.collect_list("date")).alias("a"))
    grid = b.select("ticker").distinct().select("ticker", F.explode(days.scalar()).alias("date"))
    return grid.join(b.select("ticker", "date", "close"), ["ticker", "date"], "left")


@query("ing15_ffill", with_(BARS, _GRID, body=f"""SELECT ticker, date,
  {r6('last_value(close IGNORE NULLS) OVER ' + run())} AS close FROM gb"""))
def _ffill(s, d):
    return C.ffill(month_grid(s, d), ["close"]).withColumn("close", rnd("close"))


@query("ing16_ffill_bfill", with_(BARS, _GRID, body=f"""SELECT ticker, date, {r6('''coalesce(
  last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))''')} AS close FROM gb"""))
def _bfill(s, d):
    return C.ffill_bfill(month_grid(s, d), ["close"]).withColumn("close", rnd("close"))


_VOL = f"v AS (SELECT ticker, date, {roll('stddev_samp', 'r', 20)} AS vol, r FROM (SELECT *, {ret_sql()} AS r FROM bars))"


@query("ing17_sanitise", with_(BARS, _VOL, body=f"""SELECT ticker, date, {r6('coalesce(nullif(vol, 0), 0.20)')} AS vol,
  {r6('1.0 / nullif(r, 0)', 3)} AS inv FROM v"""))
def _sanitise(s, d):
    v = I.ret_n(A.bars(s, d), 1).withColumn("vol", rolling(F.stddev_samp, "ret1", 20))
    raw = v.withColumn("inv", F.when(F.col("ret1") == 0, F.lit(float("inf"))).otherwise(1.0 / F.col("ret1")))
    out = C.sanitise(raw, {"vol": 0.20, "inv": None})
    return out.select("ticker", "date", rnd("vol").alias("vol"), rnd("inv", 3).alias("inv"))


#: All brands of the tables.
_BR = [f"Brand#{i}" for i in range(1, 26)]


@query("ing18_to_wide", None)
def _wide(s, d):
    w = C.to_wide(A.brand_bars(s, d), _BR)
    return w.select("date", *[rnd(F.col(f"`{b}`")).alias("b" + b[6:]) for b in _BR])


from .base import BRAND_BARS  # noqa: E402

ORACLES["ing18_to_wide"] = with_(BRAND_BARS, body="SELECT date, " + ", ".join(
    f"max(CASE WHEN ticker = '{b}' THEN {r6('close')} END) AS b{b[6:]}" for b in _BR) + " FROM bars GROUP BY date")


@query("ing19_normalise_date", "SELECT event_id, cast(ts AS date) AS date FROM events")
def _norm(s, d):
    return A.table(s, d, "events").select("event_id", normalise_date("ts").alias("date"))


@query("ing20_merge_fundamentals", f"""SELECT {key_sql('S', 's_suppkey')} AS ticker, cast((s_suppkey * 3) % 30 + 6 AS double) AS roce,
  coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 55.0::double END, cast(s_suppkey % 27 AS double)) AS promoter_pledge FROM supplier""")
def _mergef(s, d):
    f = A.fundamentals(s, d)
    stored = f.select("ticker", F.when(F.substring("ticker", 2, 10).cast("long") % 2 == 0, 55.0).alias("promoter_pledge"))
    return C.merge_fundamentals(f, stored, ["promoter_pledge"]).select("ticker", "roce", "promoter_pledge")


@query("ing21_statement_ratios", f"""WITH p AS (SELECT o_custkey AS k, cast(year(o_orderdate) AS int) AS year, sum(o_totalprice) AS revenue
  FROM orders GROUP BY 1, 2),
q AS (SELECT *, revenue * 0.1 - c_acctbal * 5 AS ebit, (revenue * 0.1 - c_acctbal * 5) * 0.7 - 5000 AS ni FROM p JOIN customer ON k = c_custkey),
r AS (SELECT *, lag(revenue, 1) OVER w AS r1, lag(revenue, 2) OVER w AS r2, lag(ni) OVER w AS n1,
  row_number() OVER (PARTITION BY k ORDER BY year DESC) AS rn FROM q WINDOW w AS (PARTITION BY k ORDER BY year))
SELECT {key_sql('C', 'k')} AS ticker, year, {r6('ebit / nullif(revenue * 0.9 + 5000 - revenue * 0.2, 0) * 100')} AS roce,
  {r6('ebit / abs(-(1.0::double + k % 50) * 100.003::double)', 4)} AS icr, coalesce(revenue < r1 AND r1 < r2, false) AS revenue_decline_2yr,
  coalesce(ni < 0, false) OR coalesce(n1 < 0, false) AS loss_either_year FROM r WHERE rn = 1""")
def _ratios(s, d):
    return C.statement_ratios(A.statements(s, d)).withColumn("roce", rnd("roce")).withColumn("icr", rnd("icr", 4))


@query("ing22_fundamentals_summary", """SELECT count(*) AS names, count(*) FILTER (s_suppkey % 11 = 0) AS net_loss,
  count(*) FILTER (s_suppkey % 13 = 0) AS ebitda_loss, count(*) FILTER (s_suppkey % 29 = 0) AS roe_missing,
  count(*) FILTER (s_suppkey % 29 <> 0 AND s_suppkey % 25 + 5 < 8) AS roe_low,
  count(*) FILTER ((s_suppkey * 3) % 30 + 6 < 10) AS roce_low, count(*) FILTER ((s_suppkey % 7) / 3.0 > 1.5) AS debt_high,
  count(*) FILTER (r_name = 'EUROPE') AS finance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _summary(s, d):
    return C.fundamentals_summary(A.fundamentals(s, d))
