"""Regime, calendar, filter and gate queries."""

from pyspark.sql import functions as F

from ..functions.columns import days_between, is_quarter_start, rnd
from ..operators import calendar as CAL
from ..operators import gates as G
from ..operators import indicators as I
from ..operators import regime as R
from ..sources import adapters as A
from . import frames as X
from .base import (BARS, BRAND_BARS, INDEX, MEMBERS, SECTORS, key_sql, lagx, over, query, r6, regime_sql, roll, with_)


def _idx(s, d):
    return R.synthetic_index(A.bars(s, d))


def _reg(s, d):
    return R.market_regime(_idx(s, d))


@query("reg01_synthetic_index", with_(BARS, body=f"SELECT date, {r6('avg(close) * 10.45')} AS close FROM bars GROUP BY date"))
def _r1(s, d):
    return R.synthetic_index(A.bars(s, d), R.FALLBACK_INDEX_SCALE).select("date", rnd("close").alias("close"))


@query("reg02_proxy_index", with_(BARS, SECTORS, body=f"""SELECT date, {r6('avg(close)')} AS close FROM bars
  WHERE ticker IN (SELECT ticker FROM sectors WHERE sector = 'ASIA') GROUP BY date"""))
def _r2(s, d):
    names = A.sector_map(s, d).where("sector = 'ASIA'").select("ticker")
    return R.proxy_index(A.bars(s, d), names).select("date", rnd("close").alias("close"))


@query("reg03_sma_regime", with_(BARS, INDEX, body=f"""SELECT date, {r6(roll('avg', 'close', 100, key='index_id'))} AS sma,
  close > {roll('avg', 'close', 100, key='index_id')} AS above FROM idx"""))
def _r3(s, d):
    return R.sma_regime(_idx(s, d)).select("date", rnd("sma").alias("sma"), "above")


@query("reg04_run_lengths", with_(BARS, regime_sql(), body="SELECT date, above, run_len FROM regime"))
def _r4(s, d):
    return R.run_lengths(R.sma_regime(_idx(s, d))).select("date", "above", "run_len")


_HYST = f"""w0 AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM reg1),
wk AS (SELECT i, date, above, 1 AS run, false AS state FROM w0 WHERE i = 1
  UNION ALL SELECT n.i, n.date, n.above, CASE WHEN n.above = k.above THEN k.run + 1 ELSE 1 END,
    CASE WHEN (CASE WHEN n.above = k.above THEN k.run + 1 ELSE 1 END) >= 3 THEN n.above ELSE k.state END
  FROM wk k JOIN w0 n ON n.i = k.i + 1)"""


@query("reg05_hysteresis", with_(BARS, regime_sql(), _HYST, recursive=True, body="SELECT date, state AS bullish FROM wk"))
def _r5(s, d):
    return R.hysteresis(R.sma_regime(_idx(s, d))).select("date", "bullish")


@query("reg06_bull_streak", with_(BARS, regime_sql(), body="SELECT date, streak FROM regime"))
def _r6(s, d):
    return _reg(s, d).select("date", "streak")


@query("reg07_absolute_momentum", with_(BARS, INDEX, body=f"""SELECT date,
  coalesce(close / {lagx('close', 126, 'index_id')} - 1 > 0, false) AS bullish FROM idx"""))
def _r7(s, d):
    return R.abs_momentum_regime(_idx(s, d)).select("date", "bullish")


@query("reg08_attach_regime", with_(BARS, regime_sql(), body="""SELECT ticker, b.date, coalesce(bullish, false) AS bullish
  FROM bars b LEFT JOIN regime r ON r.date = b.date"""))
def _r8(s, d):
    return R.attach_regime(A.bars(s, d), _reg(s, d)).select("ticker", "date", "bullish")


@query("reg09_regime_as_of", with_(BARS, regime_sql(), """days AS (SELECT DISTINCT cast(o_orderdate AS date) AS date FROM orders)""",
    body="""SELECT d.date, coalesce(bullish, false) AS bullish, coalesce(streak, 0) AS streak
  FROM days d ASOF LEFT JOIN regime r ON d.date >= r.date"""))
def _r9(s, d):
    days = A.table(s, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return R.regime_as_of(days, _reg(s, d))


@query("reg10_exposure_scale", with_(BARS, regime_sql(), body="""SELECT date, CASE WHEN NOT bullish THEN 0.0::double
  WHEN streak < 22 THEN 0.55::double ELSE 1.10::double END AS exposure FROM regime"""))
def _r10(s, d):
    return R.exposure_scale(_reg(s, d)).select("date", "exposure")


# ---- calendar

@query("cal01_month_end", with_(BARS, body="SELECT cast(date_trunc('month', date) AS date) AS month, max(date) AS date FROM bars GROUP BY 1"))
def _c1(s, d):
    return CAL.month_end_dates(A.bars(s, d))


@query("cal02_week_end", with_(BARS, body="SELECT cast(date_trunc('week', date) AS date) AS week, max(date) AS date FROM bars GROUP BY 1"))
def _c2(s, d):
    return CAL.week_end_dates(A.bars(s, d))


_CAL = "cal AS (SELECT DISTINCT date FROM bars)"
_NTD = "ntd AS (SELECT date, coalesce(lead(date) OVER (ORDER BY date), date) AS exec_date FROM cal)"


@query("cal03_next_trading_day", with_(BARS, _CAL, _NTD, body="SELECT * FROM ntd"))
def _c3(s, d):
    return CAL.next_trading_day(CAL.calendar(A.bars(s, d)))


@query("cal04_snap_to_trading_day", with_(BARS, _CAL, """sch AS (SELECT DISTINCT cast(date_trunc('month', o_orderdate) AS date) AS target FROM orders)""",
    body="SELECT target, date FROM sch ASOF LEFT JOIN cal ON target >= date"))
def _c4(s, d):
    sch = A.table(s, d, "orders").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("target")).distinct()
    return CAL.snap_to_trading_day(sch, CAL.calendar(A.bars(s, d)))


_HP = """rb AS (SELECT max(date) AS date FROM bars GROUP BY date_trunc('month', date)),
hp AS (SELECT * FROM (SELECT rb.date, exec_date, lead(rb.date) OVER (ORDER BY rb.date) AS next_date,
  lead(exec_date) OVER (ORDER BY rb.date) AS next_exec FROM rb JOIN ntd ON ntd.date = rb.date) WHERE next_date IS NOT NULL)"""


@query("cal05_holding_periods", with_(BARS, _CAL, _NTD, _HP, body="SELECT * FROM hp"))
def _c5(s, d):
    b = A.bars(s, d)
    return CAL.holding_periods(CAL.month_end_dates(b), CAL.calendar(b))


@query("cal06_weekday_schedule", with_(BARS, body="""SELECT cast(t AS date) AS target FROM (
  SELECT unnest(generate_series(min(date)::timestamp, max(date)::timestamp, interval 1 day)) AS t FROM bars) WHERE isodow(t) = 1"""))
def _c6(s, d):
    span = A.bars(s, d).agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return CAL.weekday_schedule(span, 0)


@query("cal07_trading_grid", with_(BARS, _CAL, body="""SELECT date FROM cal WHERE date >= date '1996-01-01'
  UNION SELECT date '2001-11-05'"""))
def _c7(s, d):
    import datetime as dt
    return CAL.trading_grid(CAL.calendar(A.bars(s, d)), "1996-01-01", dt.date(2001, 11, 5))


from .q_derivatives_sql import OPTIONS  # noqa: E402


@query("cal08_monthly_expiry", with_(BARS, OPTIONS, """far AS (SELECT symbol, date, option_type, date_trunc('month', expiry_dt) AS m,
  max(expiry_dt) AS e FROM chain WHERE expiry_dt >= date + 5 GROUP BY 1, 2, 3, 4)""",
    body="SELECT symbol, date, option_type, arg_min(e, m) AS expiry_dt FROM far GROUP BY 1, 2, 3"))
def _c8(s, d):
    return CAL.monthly_expiry(A.options(s, d))


@query("cal09_annualisation", with_(BARS, body=f"""SELECT ticker,
  {r6("count(*) / nullif((max(date) - min(date)) / 365.25::double, 0)")} AS rows_per_year, 252 AS daily, 52 AS weekly FROM bars GROUP BY ticker"""))
def _c9(s, d):
    return CAL.empirical_ann_factor(A.bars(s, d)).select(
        "ticker", rnd("rows_per_year").alias("rows_per_year"), F.lit(CAL.ann_factor("B")).alias("daily"),
        F.lit(CAL.ann_factor("?")).alias("weekly"))


@query("cal10_days_between", """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p,
  cast(l_shipdate AS date) - cast(o_orderdate AS date) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _c10(s, d):
    j = A.table(s, d, "lineitem").join(A.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
                    days_between("o_orderdate", "l_shipdate").alias("days"))


# ---- filters

@query("fil01_in_universe", with_(BARS, MEMBERS, body="""SELECT ticker, date FROM bars
  WHERE ticker IN (SELECT ticker FROM members) OR ticker = 'S0000000009'"""))
def _f1(s, d):
    return G.in_universe(A.bars(s, d), A.universe(s, d), ("S0000000009",)).select("ticker", "date")


@query("fil02_eligible", with_(BARS, X.IND_SQL, body="""SELECT ticker, date FROM ind
  WHERE close > sma200 AND avg_turnover20 > 20000 AND close > 10"""))
def _f2(s, d):
    return G.eligible(X.screen_indicators(A.bars(s, d)), 20000.0).select("ticker", "date")


@query("fil03_require", with_(BARS, X.IND_SQL, body="SELECT ticker, date FROM ind WHERE mom IS NOT NULL AND sma200 IS NOT NULL AND vol60 IS NOT NULL"))
def _f3(s, d):
    return G.require(X.screen_indicators(A.bars(s, d)), ["mom", "sma200", "vol60"]).select("ticker", "date")


@query("fil04_bear_floor", with_(BARS, regime_sql(), X.IND_SQL, body="""SELECT ticker, i.date FROM ind i
  LEFT JOIN regime r ON r.date = i.date WHERE coalesce(bullish, false) OR mom > 0.20"""))
def _f4(s, d):
    b = A.bars(s, d)
    return G.bear_floor(I.momentum(b), R.market_regime(R.synthetic_index(b))).select("ticker", "date")


@query("fil05_winners_on_pullback", with_(BARS, X.PANEL_SQL, """cut AS (SELECT date, quantile_cont(mom, 0.75) AS c FROM panel WHERE mom IS NOT NULL GROUP BY date)""",
    body=f"""SELECT ticker, p.date, {r6('c')} AS mom_cut FROM panel p JOIN cut ON cut.date = p.date WHERE mom >= c AND ret5 < -0.02"""))
def _f5(s, d):
    return G.winners_on_pullback(X.panel(s, d)).select("ticker", "date", rnd("mom_cut").alias("mom_cut"))


@query("fil06_expiry_min_gap", with_(BARS, OPTIONS, body="""SELECT symbol, date, expiry_dt, count(*) AS n FROM chain
  WHERE expiry_dt >= date + 5 GROUP BY 1, 2, 3"""))
def _f6(s, d):
    return G.expiry_min_gap(A.options(s, d)).groupBy("symbol", "date", "expiry_dt").agg(F.count(F.lit(1)).alias("n"))


@query("fil07_date_slice", with_(BARS, body="SELECT ticker, date FROM bars WHERE date BETWEEN date '1997-01-01' AND date '1998-06-30'"))
def _f7(s, d):
    return G.date_slice(A.bars(s, d), "1997-01-01", "1998-06-30").select("ticker", "date")


@query("fil08_market_hours", """SELECT event_id FROM events WHERE isodow(ts) <= 5 AND hour(ts) * 60 + minute(ts) BETWEEN 555 AND 930""")
def _f8(s, d):
    return G.market_hours(A.table(s, d, "events")).select("event_id")


@query("fil09_complete_history", with_(BARS, "mb AS (SELECT DISTINCT ticker, date_trunc('month', date) AS m FROM bars)",
    body="""SELECT ticker, count(*) AS months FROM mb GROUP BY ticker HAVING count(*) = (SELECT count(DISTINCT m) FROM mb)"""))
def _f9(s, d):
    """Complete on the monthly grid: suppliers do not trade daily."""
    m = A.bars(s, d).groupBy("ticker", F.trunc("date", "month").alias("date")).agg(F.max_by("close", "date").alias("close"))
    return G.complete_history(m).groupBy("ticker").agg(F.count(F.lit(1)).alias("months"))


@query("fil10_min_history", with_(BARS, body="""SELECT ticker, count(*) AS n FROM bars GROUP BY ticker HAVING count(*) >= 530"""))
def _f10(s, d):
    return G.min_history(A.bars(s, d), 530).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


# ---- gates

FUND_SQL = f"""fund AS MATERIALIZED (SELECT {key_sql('S', 's_suppkey')} AS ticker, s_suppkey AS k, s_acctbal, r_name = 'EUROPE' AS fin
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
fgate AS MATERIALIZED (SELECT ticker, CASE WHEN k % 11 = 0 THEN 'net_profit_negative' WHEN k % 13 = 0 THEN 'ebitda_negative'
  WHEN k % 29 <> 0 AND k % 25 + 5 < 8 THEN 'roe_low' WHEN (k * 3) % 30 + 6 < 10 THEN 'roce_low'
  WHEN k % 17 = 0 THEN 'revenue_decline' WHEN 20 + k % 50 < 25 THEN 'holding_low' WHEN k % 27 > 20 THEN 'pledge_high'
  WHEN k % 19 = 0 THEN 'pledge_rising' WHEN s_acctbal + 1000 < 500 THEN 'market_cap_low' WHEN k % 23 = 0 THEN 'auditor_flag'
  WHEN k % 31 = 0 THEN 'promoter_selling' WHEN NOT fin AND (k % 7) / 3.0::double > 1.5 THEN 'debt_high'
  WHEN NOT fin AND (k % 9) / 2.0::double + 0.25 < 1.5 THEN 'icr_low' WHEN fin AND k % 8 > 5 THEN 'npa_high'
  WHEN fin AND k % 12 + 6 < 12 THEN 'car_low' END AS reason FROM fund)"""


@query("gate01_fundamental", with_(FUND_SQL, body="SELECT ticker, reason FROM fgate"))
def _g1(s, d):
    return G.fundamental_gate(A.fundamentals(s, d)).select("ticker", "reason")


@query("gate02_quarter_start", with_(BARS, _CAL, body="SELECT date, month(date) IN (1, 4, 7, 10) AND day(date) <= 7 AS reload FROM cal"))
def _g2(s, d):
    return CAL.calendar(A.bars(s, d)).select("date", is_quarter_start("date").alias("reload"))


STATE_SQL = """st0 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars),
st AS MATERIALIZED (SELECT ticker, count(*) AS n, max(CASE WHEN rn = 1 THEN close END) AS close,
  CASE WHEN count(*) >= 50 THEN avg(CASE WHEN rn <= 50 THEN close END) END AS sma50,
  CASE WHEN count(*) >= 200 THEN avg(CASE WHEN rn <= 200 THEN close END) END AS sma200,
  max(CASE WHEN rn = 1 THEN close END) / max(CASE WHEN rn = 252 THEN close END) - 1 AS ret_12m FROM st0 GROUP BY ticker),
tgate AS MATERIALIZED (SELECT *, CASE WHEN n < 200 THEN 'short_history' WHEN close < sma200 THEN 'below_sma200' WHEN close < sma50 THEN 'below_sma50'
  WHEN ret_12m < -0.20 THEN 'fell_12m' END AS reason FROM st)"""


@query("gate03_trend", with_(BARS, STATE_SQL, body=f"SELECT ticker, reason, {r6('ret_12m')} AS ret_12m FROM tgate"))
def _g3(s, d):
    return G.trend_gate(A.bars(s, d)).select("ticker", "reason", rnd("ret_12m").alias("ret_12m"))


@query("gate04_sector_collapse", with_(BARS, SECTORS, STATE_SQL, """sm AS (SELECT sector, avg(ret_12m) AS m FROM st JOIN sectors USING (ticker) GROUP BY sector)""",
    body=f"""SELECT ticker, sector, {r6('m')} AS sector_ret, coalesce(m < -0.15 AND ret_12m < -0.10, false) AS blocked
  FROM st JOIN sectors USING (ticker) JOIN sm USING (sector)"""))
def _g4(s, d):
    return G.sector_collapse_gate(A.bars(s, d), A.sector_map(s, d)).select(
        "ticker", "sector", rnd("sector_ret").alias("sector_ret"), "blocked")


def supplier_pairs(s, d):
    """Suppliers 2k and 2k+1 as a pair."""
    k = F.col("s_suppkey")
    half = F.expr("s_suppkey div 2")
    return A.table(s, d, "supplier").groupBy(half.alias("pair_id")).agg(
        F.min(F.when(k % 2 == 0, k)).alias("a"), F.max(F.when(k % 2 == 1, k)).alias("b")
    ).where("a is not null and b is not null").select("pair_id", A.ticker_of("a").alias("leg1"), A.ticker_of("b").alias("leg2"))


PROTECT_SQL = f"""blk AS (SELECT ticker FROM fgate WHERE reason = 'roce_low' OR reason = 'auditor_flag'),
prs AS (SELECT {key_sql('S', '(s_suppkey // 2) * 2')} AS a, {key_sql('S', '(s_suppkey // 2) * 2 + 1')} AS b FROM supplier
  GROUP BY s_suppkey // 2 HAVING count(*) = 2),
prot AS (SELECT ticker FROM blk UNION SELECT a FROM prs WHERE b IN (SELECT ticker FROM blk) UNION SELECT b FROM prs WHERE a IN (SELECT ticker FROM blk))""".replace(
    "(s_suppkey // 2) * 2", "(any_value(s_suppkey) // 2) * 2")


def _blocked(s, d):
    return G.fundamental_gate(A.fundamentals(s, d)).where("reason in ('roce_low', 'auditor_flag')")


@query("gate05_protect_pairs", with_(FUND_SQL, PROTECT_SQL, body="SELECT ticker FROM prot"))
def _g5(s, d):
    return G.protect_pairs(_blocked(s, d), supplier_pairs(s, d))


def raw_signals(s, d):
    """Signals by supplier: momentum sign as position, label by key."""
    st = G.last_state(A.bars(s, d))
    k = F.substring("ticker", 2, 10).cast("long")
    return st.select("ticker", (F.coalesce("ret_12m", F.lit(0.0)) * 0.1).alias("position"),
                     F.when(k % 3 == 0, "residual_momentum").otherwise("mean_reversion").alias("signal_type"))


SIGNALS_SQL = """sig AS MATERIALIZED (SELECT ticker, coalesce(ret_12m, 0) * 0.1::double AS position,
  CASE WHEN cast(substring(ticker, 2, 10) AS bigint) % 3 = 0 THEN 'residual_momentum' ELSE 'mean_reversion' END AS signal_type FROM st)"""


@query("gate06_apply_block", with_(BARS, STATE_SQL, FUND_SQL, SIGNALS_SQL, body=f"""SELECT ticker,
  {r6("CASE WHEN hit THEN 0 ELSE position END")} AS position,
  CASE WHEN hit THEN CASE WHEN f THEN 'fundamental_blocked' ELSE 'trend_blocked' END ELSE signal_type END AS signal_type
  FROM (SELECT *, ticker IN (SELECT ticker FROM fgate WHERE reason IS NOT NULL) AS f,
    ticker IN (SELECT ticker FROM tgate WHERE reason IS NOT NULL)
      AND ticker NOT IN (SELECT ticker FROM fund WHERE k % 5 = 0) AND abs(position) >= 0.001 AS hit FROM sig)"""))
def _g6(s, d):
    blocked = G.trend_gate(A.bars(s, d)).where(F.col("reason").isNotNull())
    fund = G.fundamental_gate(A.fundamentals(s, d)).where(F.col("reason").isNotNull())
    book = A.table(s, d, "supplier").where("s_suppkey % 5 = 0").select(A.ticker_of("s_suppkey").alias("ticker"))
    return G.apply_block(raw_signals(s, d), blocked, fund, book).select("ticker", rnd("position").alias("position"), "signal_type")


@query("gate07_volume_confirm", with_(BARS, STATE_SQL, SIGNALS_SQL, """lv AS (SELECT ticker, max(CASE WHEN rn = 1 THEN volume END)
  / CASE WHEN count(volume) = 20 THEN avg(volume) END AS vr FROM st0 WHERE rn <= 20 GROUP BY ticker)""",
    body=f"""SELECT ticker, {r6('vr')} AS vol_ratio, {r6("CASE WHEN signal_type = 'mean_reversion' AND vr < 1.30 THEN 0 ELSE position END")} AS position
  FROM sig LEFT JOIN lv USING (ticker)"""))
def _g7(s, d):
    return G.volume_confirm(raw_signals(s, d), A.bars(s, d)).select(
        "ticker", rnd("vol_ratio").alias("vol_ratio"), rnd("position").alias("position"))


@query("gate08_filter_funnel", with_(BARS, STATE_SQL, FUND_SQL, """fl AS (SELECT t.ticker, true AS u, f.reason IS NULL AS fu, t.reason IS NULL AS tr
  FROM tgate t LEFT JOIN fgate f USING (ticker))""", body="""
  SELECT 1 AS step, 'universe' AS stage, count(*) FILTER (u) AS "left" FROM fl
  UNION ALL SELECT 2, 'fundamental', count(*) FILTER (u AND fu) FROM fl
  UNION ALL SELECT 3, 'trend', count(*) FILTER (u AND fu AND tr) FROM fl"""))
def _g8(s, d):
    f = G.fundamental_gate(A.fundamentals(s, d)).select("ticker", F.col("reason").isNull().alias("fundamental"))
    t = G.trend_gate(A.bars(s, d)).select("ticker", F.col("reason").isNull().alias("trend"))
    flagged = t.join(f, "ticker", "left").withColumn("universe", F.lit(True))
    return G.filter_funnel(flagged, ["universe", "fundamental", "trend"])
