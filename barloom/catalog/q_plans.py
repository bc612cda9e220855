"""Whole jobs: the screen, the factor model and the back-test."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import regime as R
from ..operators.calendar import week_end_dates
from ..plans import backtest as BT
from ..plans import factor_model as FM
from ..plans.screen import momentum_screen
from ..schemas import FactorParams, ScreenParams
from ..sources import adapters as A
from ..sources.scratch import cut
from . import frames as X
from .base import BARS, ORACLES, SECTORS, query, r6, regime_sql, with_
from .q_joins import filled_bars
from .q_portfolio import r

SCREEN = f"""lr AS (SELECT * FROM ind QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
now AS (SELECT coalesce(bullish, false) AS bullish, CASE WHEN NOT bullish THEN 0.55::double WHEN streak < 22 THEN 0.55::double ELSE 1.10::double END AS lev
  FROM regime WHERE date = (SELECT max(date) FROM bars)),
ca AS (SELECT lr.*, coalesce(mom / (vol60 + 0.000001::double), mom) AS ram FROM lr, now WHERE sma200 IS NOT NULL AND mom IS NOT NULL AND vol60 IS NOT NULL
  AND close > sma200 AND avg_turnover20 > 20000 AND close > 10 AND (bullish OR mom > 0)),
held AS (SELECT *, 1 AS config_id FROM (SELECT *, row_number() OVER (ORDER BY ram DESC, ticker) AS slot FROM ca) WHERE slot <= 5),
mw AS (SELECT config_id, DATE '2000-01-01' AS date, ticker, slot, close, mom, {X._MW} AS weight FROM held WINDOW k AS (PARTITION BY config_id)),
{X.cap_sql('mw', 'book')}"""


def screen(s, d):
    return momentum_screen(A.bars(s, d), 20000.0, params=ScreenParams(bear_momentum=0.0))


@query("screen_momentum", with_(BARS, regime_sql(), X.IND_SQL, SCREEN, body=f"SELECT slot, ticker, {r6('close')} AS close, {r6('mom')} AS mom, {r6('weight * (SELECT lev FROM now)')} AS weight FROM book"))
def _screen(s, d):
    return r(screen(s, d), "close", "mom", "weight").select(F.col("slot").cast("long").alias("slot"), "ticker", "close", "mom", "weight")


ORACLES["src07_signals_document"] = with_(BARS, regime_sql(), X.IND_SQL, SCREEN, SECTORS, body=f"""SELECT 'screen' AS regime, 1000000.0::double AS portfolio_value,
  (SELECT count(DISTINCT sector) FROM book JOIN sectors USING (ticker)) AS n_sectors, slot, ticker, sector, 'BUY' AS signal, {r6('close')} AS price FROM book JOIN sectors USING (ticker)""")
ORACLES["src06_held_from_signals"] = with_(BARS, regime_sql(), X.IND_SQL, SCREEN, body="SELECT ticker FROM book")


@query("factor_model_signals")
def _factor(s, d):
    bars = cut(filled_bars(s, d), "bars")
    x = FM.FactorInputs(
        bars=bars, index=R.synthetic_index(bars), sectors=A.brand_sectors(s, d), pairs=A.brand_pairs(s, d),
        eligible=A.table(s, d, "part").select(F.col("p_brand").alias("ticker")).distinct(),
        rebalances=week_end_dates(bars),
    )
    sig = FM.factor_signals(x, FactorParams())
    return r(sig.select("ticker", "sector", "position", "z_score", "signal_type", "effective_cost", "vol_ratio", "confidence", "partner"), "position", "z_score", "vol_ratio", "confidence")


# The back-test in SQL, from the rule: every month end is a rebalance; in a bear state the book is empty and the
# holdings are forgotten; weights carry the exposure; a name's first day in a period and days without its bar count 0.
_STEP = X.HOLD_STEP
BACKTEST = f"""cal AS MATERIALIZED (SELECT me.date, row_number() OVER (ORDER BY me.date) AS i, lead(me.date) OVER (ORDER BY me.date) AS nd,
    CASE WHEN NOT coalesce(g.bullish, false) THEN 0 WHEN g.streak < 22 THEN 0.55::double ELSE 1.10::double END AS ex
  FROM me LEFT JOIN regime g ON g.date = me.date),
cn AS MATERIALIZED (SELECT cal.date, i, CASE WHEN ex = 0 THEN cast([] AS varchar[]) ELSE coalesce(list(ticker ORDER BY rank) FILTER (ticker IS NOT NULL), cast([] AS varchar[])) END AS names
  FROM cal LEFT JOIN ranked r ON r.date = cal.date GROUP BY cal.date, i, ex),
wk AS (SELECT i, date, {_STEP.replace('HELD', "cast([] AS varchar[])").replace('NAMES', 'names')} AS book FROM cn WHERE i = 1
  UNION ALL SELECT n.i, n.date, {_STEP.replace('HELD', 'w.book').replace('NAMES', 'n.names')} FROM wk w JOIN cn n ON n.i = w.i + 1),
held AS (SELECT 1 AS config_id, u.date, u.ticker, p.mom FROM (SELECT date, unnest(book) AS ticker FROM wk) u JOIN panel p ON p.date = u.date AND p.ticker = u.ticker),
mw AS (SELECT *, {X._MW} AS weight FROM held WINDOW k AS (PARTITION BY config_id, date)),
{X.cap_sql('mw', 'capped_book')},
book AS MATERIALIZED (SELECT b.date, b.ticker, weight * ex AS weight FROM capped_book b JOIN cal ON cal.date = b.date),
bd AS MATERIALIZED (SELECT date, nd FROM cal WHERE date >= (SELECT min(date) FROM book)),
od AS (SELECT nd AS date, ticker, weight AS w0 FROM book JOIN bd USING (date) WHERE nd IS NOT NULL),
dr AS (SELECT coalesce(b.date, od.date) AS entry, sum(abs(coalesce(weight, 0) - coalesce(w0, 0))) * 0.0015 AS drag
  FROM book b FULL JOIN od ON od.date = b.date AND od.ticker = b.ticker GROUP BY 1),
dz AS (SELECT entry, date, sum(weight * coalesce(close / prev - 1, 0)) AS ret FROM (
  SELECT b.date AS entry, b.weight, x.date, x.close, lag(x.close) OVER (PARTITION BY b.ticker, b.date ORDER BY x.date) AS prev
  FROM book b JOIN bd ON bd.date = b.date JOIN bars x ON x.ticker = b.ticker AND x.date > b.date AND x.date <= nd) GROUP BY 1, 2),
dy AS (SELECT bd.date AS entry, c.date, coalesce(ret, 0) AS ret FROM bd JOIN (SELECT DISTINCT date FROM bars) c ON c.date > bd.date AND c.date <= nd
  LEFT JOIN dz ON dz.entry = bd.date AND dz.date = c.date),
nt AS MATERIALIZED (SELECT date, ret - CASE WHEN row_number() OVER (PARTITION BY dy.entry ORDER BY date) = 1 THEN coalesce(drag, 0) ELSE 0 END AS ret FROM dy LEFT JOIN dr ON dr.entry = dy.entry),
eq AS MATERIALIZED (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS capital FROM nt)"""
_BT = (BARS, X.PANEL_SQL, X.RANKED_SQL, regime_sql(), BACKTEST)


@query("backtest_momentum_equity", with_(*_BT, recursive=True, body=f"SELECT date, {r6('ret')} AS ret, {r6('capital')} AS capital FROM eq"))
def _equity(s, d):
    return r(BT.backtest(A.bars(s, d))[0], "ret", "capital").select("date", "ret", "capital")


@query("backtest_momentum_metrics", with_(*_BT, recursive=True, body=f"""SELECT
  {r6('pow(arg_max(capital, date) / arg_min(capital, date), 1 / ((max(date) - min(date)) / 365.25::double)) - 1')} AS cagr,
  {r6('stddev_samp(ret) * sqrt(252.0::double)')} AS ann_vol, {r6('(avg(ret) - 0.06::double / 252) * sqrt(252.0::double) / stddev_samp(ret)')} AS sharpe,
  {r6('(avg(ret) - 0.06::double / 252) * sqrt(252.0::double) / stddev_samp(CASE WHEN ret < 0 THEN ret END)')} AS sortino,
  {r6('min(dd) * 100')} AS max_drawdown FROM (SELECT *, capital / greatest(1.0, max(capital) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) - 1 AS dd FROM eq)"""))
def _stats(s, d):
    return r(BT.backtest(A.bars(s, d))[1].drop("config_id"), "cagr", "ann_vol", "sharpe", "sortino", "max_drawdown")
