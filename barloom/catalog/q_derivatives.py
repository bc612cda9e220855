"""Open-interest and option-spread queries."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import aggregates as AG
from ..operators import calendar as CAL
from ..operators import derivatives as D
from ..operators.joins import alike
from ..operators import metrics as M
from ..operators import regime as R
from ..sources import adapters as A
from ..sources.scratch import cut
from .base import BARS, query, r6, regime_sql, with_
from .q_derivatives_sql import FUTURES, OPTIONS, round_strike
from .q_portfolio import r


def states(s, d, bars=None):
    f = D.oi_changes(D.oi_baseline(A.futures(s, d, bars)))
    return D.confirm_n(D.oi_state(D.dynamic_thresholds(f, A.INDEX_TICKERS)))


_W = "(PARTITION BY symbol ORDER BY date)"
_W5 = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
STATES = FUTURES + f""",
f1 AS (SELECT *, CASE WHEN count(open_int) OVER {_W5} >= 3 THEN avg(open_int) OVER {_W5} END AS oi_base, lag(close) OVER {_W} AS pc FROM fut),
f2 AS (SELECT *, (open_int - oi_base) / nullif(oi_base, 0) AS oi_chg, (close - pc) / nullif(pc, 0) AS px_chg,
  CASE WHEN instrument = 'FUTIDX' THEN 0.0::double ELSE 0.05::double END AS oi_thr, CASE WHEN instrument = 'FUTIDX' THEN 0.001::double ELSE 0.005::double END AS px_thr FROM f1),
f3 AS (SELECT *, CASE WHEN oi_chg > oi_thr AND px_chg >= px_thr THEN 'Long Buildup' WHEN oi_chg > oi_thr AND px_chg <= -px_thr THEN 'Short Buildup'
  WHEN oi_chg < -oi_thr AND px_chg >= px_thr THEN 'Short Covering' WHEN oi_chg < -oi_thr AND px_chg <= -px_thr THEN 'Long Unwinding' ELSE 'Neutral' END AS state FROM f2),
fs AS MATERIALIZED (SELECT *, state <> 'Neutral' AND coalesce(state = lag(state, 1) OVER {_W}, false) AND coalesce(state = lag(state, 2) OVER {_W}, false) AS confirmed FROM f3)"""


@query("drv01_oi_baseline", with_(BARS, STATES, body=f"SELECT symbol, date, {r6('oi_base')} AS oi_base FROM fs"))
def _1(s, d):
    return r(D.oi_baseline(A.futures(s, d)), "oi_base").select("symbol", "date", "oi_base")


@query("drv02_oi_changes", with_(BARS, STATES, body=f"SELECT symbol, date, {r6('oi_chg')} AS oi_chg, {r6('px_chg')} AS px_chg FROM fs"))
def _2(s, d):
    return r(states(s, d), "oi_chg", "px_chg").select("symbol", "date", "oi_chg", "px_chg")


@query("drv03_oi_state", with_(BARS, STATES, body="SELECT symbol, date, state FROM fs"))
def _3(s, d):
    return states(s, d).select("symbol", "date", "state")


@query("drv04_dynamic_thresholds", with_(BARS, STATES, body="SELECT symbol, date, oi_thr, px_thr FROM fs"))
def _4(s, d):
    return states(s, d).select("symbol", "date", "oi_thr", "px_thr")


@query("drv05_confirm", with_(BARS, STATES, body="SELECT symbol, date, confirmed FROM fs"))
def _5(s, d):
    return states(s, d).select("symbol", "date", "confirmed")


def regime(s, d):
    return R.market_regime(R.synthetic_index(A.bars(s, d)))


SETUPS = """su AS MATERIALIZED (SELECT fs.* FROM fs LEFT JOIN regime g ON g.date = fs.date WHERE state <> 'Neutral' AND (instrument = 'FUTIDX' OR coalesce(bullish, false)))"""


def setups(s, d):
    return D.regime_mask(states(s, d).where("state <> 'Neutral'"), regime(s, d))


@query("drv06_regime_mask", with_(BARS, regime_sql(), STATES, SETUPS, body="SELECT symbol, date, state FROM su"))
def _6(s, d):
    return setups(s, d).select("symbol", "date", "state")


_SCORE = "least(99, cast(trunc((abs(oi_chg) * 0.6 + abs(px_chg) * 0.4) * 500) AS int))"


@query("drv07_oi_score", with_(BARS, regime_sql(), STATES, SETUPS, body=f"SELECT symbol, date, {_SCORE} AS alpha_score FROM su ORDER BY {_SCORE} DESC, symbol, date LIMIT 15"))
def _7(s, d):
    return D.oi_score(setups(s, d)).select("symbol", "date", "alpha_score")


@query("drv08_instrument_tag", with_(BARS, FUTURES, body="""SELECT symbol, date, CASE WHEN instrument = 'FUTIDX' THEN CASE WHEN symbol LIKE '%0001' THEN '0001' ELSE 'INDEX' END ELSE 'STOCK' END AS tag FROM fut"""))
def _8(s, d):
    return A.futures(s, d).select("symbol", "date", D.instrument_tag("symbol", "instrument", ("0001",)).alias("tag"))


@query("drv09_round_strike", with_(BARS, body=f"SELECT ticker, date, {round_strike('close')} AS strike, {round_strike('close * 1.03::double')} AS up, {round_strike('close * 20')} AS big FROM bars"))
def _9(s, d):
    return A.bars(s, d).select("ticker", "date", D.round_strike("close").alias("strike"), D.round_strike(F.col("close") * 1.03).alias("up"), D.round_strike(F.col("close") * 20).alias("big"))


SPREADS = f"""sp AS MATERIALIZED (SELECT symbol, date, state, close, CASE WHEN state = 'Long Buildup' THEN 'CE' ELSE 'PE' END AS option_type,
  CASE WHEN state = 'Long Buildup' THEN 'Bull Call Spread' ELSE 'Bear Put Spread' END AS action, {round_strike('close')} AS atm_strike,
  CASE WHEN state = 'Long Buildup' THEN {round_strike('close * 1.03::double')} ELSE {round_strike('close * 0.97::double')} END AS otm_strike
  FROM fs WHERE state IN ('Long Buildup', 'Short Buildup'))"""


def spreads(s, d, bars=None):
    return D.build_spread(states(s, d, bars).select("symbol", "date", "close", "state"))


@query("drv10_build_spread", with_(BARS, STATES, SPREADS, body="SELECT symbol, date, action, option_type, atm_strike, otm_strike FROM sp"))
def _10(s, d):
    return spreads(s, d).select("symbol", "date", "action", "option_type", "atm_strike", "otm_strike")


PRICED_SP = """mx AS (SELECT symbol, date, option_type, arg_min(e, m) AS expiry_dt FROM (SELECT symbol, date, option_type, date_trunc('month', expiry_dt) AS m, max(expiry_dt) AS e
  FROM chain WHERE expiry_dt >= date + 5 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
lg AS (SELECT sp.symbol, sp.date, sp.option_type, sp.action, sp.atm_strike, sp.otm_strike, mx.expiry_dt, a.lot_size, a.close - o.close AS net_debit, abs(sp.atm_strike - sp.otm_strike) AS width
  FROM sp JOIN mx ON mx.symbol = sp.symbol AND mx.date = sp.date AND mx.option_type = sp.option_type
  JOIN chain a ON a.symbol = sp.symbol AND a.date = sp.date AND a.option_type = sp.option_type AND a.expiry_dt = mx.expiry_dt AND a.strike = sp.atm_strike
  JOIN chain o ON o.symbol = sp.symbol AND o.date = sp.date AND o.option_type = sp.option_type AND o.expiry_dt = mx.expiry_dt AND o.strike = sp.otm_strike),
ln AS (SELECT *, greatest(1, cast(trunc(20000 / (net_debit * lot_size)) AS int)) AS lots FROM lg WHERE net_debit > 0),
pr AS MATERIALIZED (SELECT *, lots * lot_size * net_debit AS risk_rs, (width - net_debit) * lot_size * lots AS max_profit_rs FROM ln WHERE net_debit < width AND lots * lot_size * net_debit <= 22000)"""
SP = (BARS, OPTIONS, STATES, SPREADS, PRICED_SP)


def written_bars(s, d):
    """What futures and chain read of the bars, written once: lines are joined and summed up for it once."""
    return cut(A.bars(s, d).select("ticker", "date", "close", "volume"), "bars")


def priced(s, d, bars=None):
    """The chain is cut to the signals' (symbol, date, type) where it lies, and written once, an expiry with the quotes of the signals' strikes."""
    bars = written_bars(s, d) if bars is None else bars
    on = ["symbol", "date", "option_type"]
    wanted = cut(spreads(s, d, bars), "spreads")
    strikes = F.flatten(F.collect_list(F.array("atm_strike", "otm_strike"))).alias("strikes")
    asked = wanted.repartition(A.chain_parts(s, d), "symbol", "date").groupBy(*on).agg(strikes).alias("a")
    met = (F.col("c.symbol") == F.col("a.symbol")) & (F.col("c.date") == F.col("a.date")) & alike(F.col("c.option_type"), F.col("a.option_type"))
    near = A.options(s, d, bars).alias("c").join(asked.hint("shuffle_hash"), met).select("c.*", "a.strikes")
    of_leg = F.when(F.array_contains("strikes", F.col("strike")), F.struct("strike", "close", "lot_size"))
    near = cut(near.groupBy(*on, "expiry_dt").agg(F.collect_list(of_leg).alias("quotes")), "chain-of-signals")
    return D.price_spread(wanted.join(CAL.monthly_expiry(near), on), near.select(*on, "expiry_dt", F.inline("quotes")))


@query("drv11_price_spread", with_(*SP, body=f"SELECT symbol, date, option_type, expiry_dt, lots, {r6('net_debit')} AS net_debit, {r6('risk_rs', 4)} AS risk_rs, {r6('max_profit_rs', 4)} AS max_profit_rs FROM pr"))
def _11(s, d):
    p = r(r(priced(s, d), "net_debit"), "risk_rs", "max_profit_rs", places=4)
    return p.select("symbol", "date", "option_type", "expiry_dt", "lots", "net_debit", "risk_rs", "max_profit_rs")


TAKE = """tp0 AS (SELECT pr.symbol, pr.date AS entry_date, pr.option_type, pr.expiry_dt, a.date, (a.close - o.close - net_debit) * pr.lot_size * lots AS pnl, a.close - o.close AS prem, max_profit_rs
  FROM pr JOIN chain a ON a.symbol = pr.symbol AND a.option_type = pr.option_type AND a.expiry_dt = pr.expiry_dt AND a.strike = pr.atm_strike AND a.date > pr.date AND a.date <= pr.expiry_dt
  JOIN chain o ON o.symbol = pr.symbol AND o.option_type = pr.option_type AND o.expiry_dt = pr.expiry_dt AND o.strike = pr.otm_strike AND o.date = a.date),
tp AS MATERIALIZED (SELECT symbol, entry_date, option_type, expiry_dt, min(date) AS exit_date, arg_min(pnl, date) AS exit_pnl, arg_min(prem, date) AS exit_premium FROM tp0 WHERE pnl >= max_profit_rs * 0.5 GROUP BY 1, 2, 3, 4)"""


@query("drv12_take_profit_exit", with_(*SP, TAKE, body=f"""SELECT pr.symbol, pr.date AS entry_date, pr.option_type, tp.exit_date, {r6('exit_pnl', 4)} AS exit_pnl FROM pr LEFT JOIN tp
  ON tp.symbol = pr.symbol AND tp.entry_date = pr.date AND tp.option_type = pr.option_type AND tp.expiry_dt = pr.expiry_dt"""))
def _12(s, d):
    bars = written_bars(s, d)
    return r(D.take_profit_exit(priced(s, d, bars), A.options(s, d, bars, "month"), parts=A.chain_parts(s, d)), "exit_pnl", places=4).select("symbol", "entry_date", "option_type", "exit_date", "exit_pnl")


SETTLE = """sl AS (SELECT pr.symbol, pr.date, pr.option_type, max(f.date) AS settle_date, arg_max(f.close, f.date) AS spot FROM pr JOIN fut f ON f.symbol = pr.symbol AND f.date > pr.date AND f.date <= pr.expiry_dt GROUP BY 1, 2, 3),
st1 AS (SELECT pr.*, settle_date, spot, CASE WHEN pr.option_type = 'CE' THEN spot - atm_strike ELSE atm_strike - spot END AS gain FROM pr JOIN sl ON sl.symbol = pr.symbol AND sl.date = pr.date AND sl.option_type = pr.option_type),
se AS MATERIALIZED (SELECT *, CASE WHEN gain >= width THEN width WHEN gain <= 0 THEN 0 ELSE gain END AS prem, (CASE WHEN gain >= width THEN width WHEN gain <= 0 THEN 0 ELSE gain END - net_debit) * lot_size * lots AS pnl FROM st1)"""


@query("drv13_expiry_payoff", with_(*SP, SETTLE, body=f"SELECT symbol, date AS entry_date, option_type, settle_date, {r6('prem')} AS settle_premium, {r6('pnl', 4)} AS settle_pnl FROM se"))
def _13(s, d):
    bars = written_bars(s, d)
    e = D.expiry_payoff(priced(s, d, bars).withColumnRenamed("date", "entry_date"), A.futures(s, d, bars))
    return r(r(e, "settle_premium"), "settle_pnl", places=4).select("symbol", "entry_date", "option_type", "settle_date", "settle_premium", "settle_pnl")


JOURNAL = """jr AS MATERIALIZED (SELECT se.symbol, se.date AS entry_date, se.option_type, coalesce(tp.exit_date, settle_date) AS exit_date, coalesce(exit_pnl, pnl) AS pnl,
  CASE WHEN tp.exit_date IS NOT NULL THEN '50% Profit Exit' ELSE 'Expiry' END AS note FROM se LEFT JOIN tp ON tp.symbol = se.symbol AND tp.entry_date = se.date AND tp.option_type = se.option_type AND tp.expiry_dt = se.expiry_dt)"""


def journal(s, d):
    bars = written_bars(s, d)
    return D.spread_exits(priced(s, d, bars), A.options(s, d, bars, "month"), A.futures(s, d, bars), A.chain_parts(s, d))


@query("drv14_spread_journal", with_(*SP, TAKE, SETTLE, JOURNAL, body=f"SELECT symbol, entry_date, option_type, exit_date, note, {r6('pnl', 4)} AS pnl FROM jr"))
def _14(s, d):
    return r(journal(s, d), "pnl", places=4).select("symbol", "entry_date", "option_type", "exit_date", "note", "pnl")


@query("drv14_journal_statistics", with_(*SP, TAKE, SETTLE, JOURNAL, body=f"""SELECT cast(date_trunc('month', entry_date) AS date) AS month, count(*) AS trades,
  {r6('count(*) FILTER (pnl > 0) / count(*)::double * 100', 4)} AS win_rate, {r6('sum(pnl)', 2)} AS total FROM jr GROUP BY 1"""))
def _14b(s, d):
    j = journal(s, d).withColumn("month", F.trunc("entry_date", "month"))
    return j.groupBy("month").agg(F.count(F.lit(1)).alias("trades"), rnd(F.count_if(F.col("pnl") > 0) / F.count(F.lit(1)) * 100, 4).alias("win_rate"), rnd(F.sum("pnl"), 2).alias("total"))


@query("drv15_order_by_reward", with_(*SP, body=f"SELECT symbol, date, {r6('max_profit_rs / risk_rs')} AS reward_risk FROM pr"))
def _15(s, d):
    return r(D.order_by_reward(priced(s, d)), "reward_risk").select("symbol", "date", "reward_risk")
