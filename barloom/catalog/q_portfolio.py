"""Portfolio construction, attribution and performance queries."""

from pyspark.sql import functions as F

from ..functions.columns import div, rnd
from ..functions.windows import lag
from ..operators import attribution as AT
from ..operators import calendar as CAL
from ..operators import indicators as I
from ..operators import metrics as M
from ..operators import portfolio as P
from ..operators import regime as R
from ..sources import adapters as A
from ..sources.scratch import cut
from . import frames as X
from .base import BARS, BRAND_BARS, INDEX, PRICED, TRADES, over, query, r6, regime_sql, ret_sql, run, with_
from .q_aggregates import PNL_SQL, sell_pnl
from .q_joins import LABEL_SQL, labels

PB = (BARS, X.PANEL_SQL, X.RANKED_SQL)
K1 = ("config_id", "date")


def r(df, *cols, places=6):
    """Round the named columns of a report."""
    for c in cols:
        df = df.withColumn(c, rnd(c, places))
    return df


@query("prt01_hold_buffer", with_(*PB, X.HOLD_SQL, recursive=True, body="SELECT date, ticker, cast(slot AS int) AS slot FROM hold"))
def _p1(s, d):
    return P.hold_buffer(X.ranked(s, d), 5, 15).select("date", "ticker", "slot")


@query("prt02_hold_buffer_v1", with_(*PB, X.HOLD_V1_SQL, recursive=True, body="SELECT date, ticker, cast(slot AS int) AS slot FROM holdv"))
def _p2(s, d):
    return P.hold_buffer_v1(X.ranked(s, d), 5, 15).select("date", "ticker", "slot")


@query("prt03_equal_weights", with_(*PB, body=f"SELECT date, ticker, {r6('1.0::double / count(*) OVER (PARTITION BY date)')} AS weight FROM ranked WHERE rank <= 5"))
def _p3(s, d):
    return r(P.equal_weights(X.ranked(s, d).where("rank <= 5")), "weight").select("date", "ticker", "weight")


_IV = "1.0::double / coalesce(nullif(vol60, 0), 0.20::double)"


@query("prt04_inverse_vol_weights", with_(*PB, body=f"SELECT date, ticker, {r6(f'{_IV} / sum({_IV}) OVER (PARTITION BY date)')} AS weight FROM ranked WHERE rank <= 5"))
def _p4(s, d):
    return r(P.inverse_vol_weights(X.ranked(s, d).where("rank <= 5"), "vol60"), "weight").select("date", "ticker", "weight")


@query("prt05_momentum_weights", with_(*PB, "held AS (SELECT * FROM ranked WHERE rank <= 5)", body=f"SELECT date, ticker, {r6(X._MW)} AS weight FROM held WINDOW k AS (PARTITION BY date)"))
def _p5(s, d):
    return r(P.momentum_weights(X.ranked(s, d).where("rank <= 5")), "weight").select("date", "ticker", "weight")


@query("prt06_cap_weights", with_(*X.BOOK, recursive=True, body=f"SELECT date, ticker, {r6('weight')} AS weight FROM book"))
def _p6(s, d):
    return r(X.book(s, d), "weight").select("date", "ticker", "weight")


@query("prt07_scale_weights", with_(*X.BOOK, regime_sql(), recursive=True, body=f"""SELECT b.date, ticker, {r6('''weight * coalesce(CASE WHEN NOT bullish THEN 0.0
  WHEN streak < 22 THEN 0.55 ELSE 1.10 END, 0)''')} AS weight FROM book b LEFT JOIN regime g ON g.date = b.date"""))
def _p7(s, d):
    reg = R.exposure_scale(R.market_regime(R.synthetic_index(A.bars(s, d))))
    return r(P.scale_weights(X.book(s, d), reg), "weight").select("date", "ticker", "weight")


def sized(s, d):
    pan = X.panel(s, d).select("date", "ticker", "avg_volume5")
    return X.book(s, d).withColumnRenamed("close", "price").join(pan, ["date", "ticker"])


_SIZED = """sized AS (SELECT b.*, p.avg_volume5, cast(trunc(coalesce(avg_volume5, 0) * 0.05::double) AS bigint) AS lim,
  cast(trunc(weight * 1000000 / b.close) AS bigint) AS want FROM book b JOIN panel p ON p.date = b.date AND p.ticker = b.ticker)"""


@query("prt08_size_shares", with_(*X.BOOK, _SIZED, recursive=True, body="""SELECT date, ticker, lim AS max_volume_shrs, least(want, lim) AS strict,
  CASE WHEN lim > 0 THEN least(want, lim) ELSE want END AS lenient FROM sized"""))
def _p8(s, d):
    w = sized(s, d)
    a = P.size_shares(w, 1e6).withColumnRenamed("target_shrs", "strict")
    b = P.size_shares(a, 1e6, variant="lenient").withColumnRenamed("target_shrs", "lenient")
    return b.select("date", "ticker", "max_volume_shrs", "strict", "lenient")


@query("prt09_label_orders", with_(*X.BOOK, _SIZED, recursive=True, body=f"""SELECT date, ticker, CASE WHEN slot > 4 THEN 'TRACK' WHEN h THEN 'HOLD' ELSE 'BUY' END AS signal,
  CASE WHEN slot > 4 THEN 'OBSERVATION ONLY' WHEN h THEN 'HOLD (Buffer)' ELSE 'NEW ENTRY' END AS tech_status,
  CASE WHEN slot > 4 THEN 0 ELSE least(want, lim) END AS target_shrs
  FROM (SELECT *, cast(substring(ticker, 2, 10) AS bigint) % 2 = 0 AS h FROM sized)"""))
def _p9(s, d):
    held = A.table(s, d, "supplier").where("s_suppkey % 2 = 0").select(A.ticker_of("s_suppkey").alias("ticker"))
    z = P.size_shares(sized(s, d), 1e6).withColumn("selected", F.col("slot") <= 4)
    return P.label_orders(z, held).select("date", "ticker", "signal", "tech_status", "target_shrs")


@query("prt10_flush_list", with_(*X.BOOK, regime_sql(), recursive=True, body="""SELECT b.date, ticker, 'sell' AS action FROM book b
  WHERE b.date IN (SELECT date FROM regime WHERE NOT bullish)"""))
def _p10(s, d):
    reg = R.market_regime(R.synthetic_index(A.bars(s, d)))
    return P.flush_list(X.book(s, d).select("date", "ticker"), reg).select("date", "ticker", "action")


CHANGES = """bd AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM me WHERE date >= (SELECT min(date) FROM book)),
od AS (SELECT nd AS date, ticker, weight AS w0 FROM book JOIN bd USING (date) WHERE nd IS NOT NULL),
chg AS MATERIALIZED (SELECT coalesce(b.date, od.date) AS date, coalesce(b.ticker, od.ticker) AS ticker, coalesce(weight, 0) AS w1, coalesce(w0, 0) AS w0
  FROM book b FULL JOIN od ON od.date = b.date AND od.ticker = b.ticker)"""


@query("prt11_turnover", with_(*X.BOOK, CHANGES, recursive=True, body=f"SELECT date, {r6('sum(abs(w1 - w0))')} AS turnover FROM chg GROUP BY date"))
def _p11(s, d):
    b, _, dates = X.book_and_panel(s, d)
    return r(P.turnover(b, dates=dates), "turnover").select("date", "turnover")


@query("prt12_cost_drag", with_(*X.BOOK, CHANGES, recursive=True, body=f"SELECT date, {r6('sum(abs(w1 - w0)) * 0.0015 * 1.1', 8)} AS drag FROM chg GROUP BY date"))
def _p12(s, d):
    b, _, dates = X.book_and_panel(s, d)
    return r(P.cost_drag(P.turnover(b, dates=dates), 0.0015, 1.1), "drag", places=8).select("date", "drag")


_COST = "sum(abs(w1 - w0)) * 0.0003 + sum(greatest(w0 - w1, 0)) * 0.001 + sum(abs(w1 - w0)) * 0.0002 + sum(abs(w1 - w0)) * 0.0005"


@query("prt13_itemised_cost", with_(*X.BOOK, CHANGES, recursive=True, body=f"""SELECT date, {r6('sum(greatest(w0 - w1, 0)) * 0.001', 9)} AS sell_tax,
  {r6(_COST, 9)} AS cost FROM chg GROUP BY date"""))
def _p13(s, d):
    return r(P.itemised_cost(X.book(s, d)), "sell_tax", "cost", places=9).select("date", "sell_tax", "cost")


@query("prt14_adv_slippage", with_(BARS, body=f"""SELECT ticker, date, {r6('0.9::double / volume')} AS participation,
  CASE WHEN 0.9::double / volume <= 0.02 THEN 0.005::double WHEN 0.9::double / volume <= 0.05 THEN 0.0075::double WHEN 0.9::double / volume <= 0.10 THEN 0.01::double ELSE 0.015::double END AS slippage FROM bars"""))
def _p14(s, d):
    o = A.bars(s, d).select("ticker", "date", F.lit(0.9).alias("shares"), F.col("volume").alias("adv"))
    return r(P.adv_slippage(o), "participation").select("ticker", "date", "participation", "slippage")


@query("prt15_gap_slippage", with_(BARS, body=f"SELECT ticker, date, CASE WHEN lead(open) OVER {over()} / close - 1 > 0.02 THEN 0.005::double ELSE 0.0::double END AS gap_slippage FROM bars"))
def _p15(s, d):
    return P.gap_slippage(I.exec_gap(A.bars(s, d))).select("ticker", "date", "gap_slippage")


_V20 = "(PARTITION BY portfolio ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("prt16_vol_target_leverage", with_(BRAND_BARS, X.EQUITY_SQL, f"""v AS (SELECT *, CASE WHEN count(ret) OVER {_V20} = 20
  THEN stddev_pop(ret) OVER {_V20} * sqrt(252.0::double) END AS v FROM equity)""", body=f"""SELECT portfolio, date, {r6('''CASE WHEN v < 0.15
  THEN least(1.5, 0.30 / (v + 0.01)) WHEN v > 0.35 THEN greatest(0.5, 0.30 / (v + 0.01)) ELSE 1.0 END''')} AS leverage FROM v"""))
def _p16(s, d):
    return r(P.vol_target_leverage(X.brand_equity(s, d)), "leverage").select("portfolio", "date", "leverage")


@query("prt17_no_trade_band", with_(*X.BOOK, CHANGES, recursive=True, body=f"""SELECT date, ticker, abs(w1 - w0) > 0.02 AS trade,
  {r6('CASE WHEN abs(w1 - w0) > 0.02 THEN w1 ELSE w0 END')} AS new_value FROM chg"""))
def _p17(s, d):
    b, _, dates = X.book_and_panel(s, d)
    ch = P.weight_changes(b, dates=dates).withColumnRenamed("weight", "target").withColumnRenamed("old_weight", "current")
    return r(P.no_trade_band(ch, 1.0), "new_value").select("date", "ticker", "trade", "new_value")


# ---- attribution

@query("att01_open_to_open_label", with_(BARS, LABEL_SQL, body=f"SELECT date, ticker, {r6('label')} AS label FROM labels_"))
def _t1(s, d):
    return r(labels(s, d, brands=False), "label")


BASKET = """br AS MATERIALIZED (SELECT bd.date, coalesce(avg(coalesce(n.close, p.close) / p.close - 1), 0) AS ret, count(p.close) AS names FROM bd LEFT JOIN book b ON bd.date = b.date
  LEFT JOIN panel p ON p.date = b.date AND p.ticker = b.ticker LEFT JOIN panel n ON n.date = nd AND n.ticker = b.ticker WHERE nd IS NOT NULL GROUP BY bd.date)"""


@query("att02_basket_return", with_(*X.BOOK, CHANGES, BASKET, recursive=True, body=f"SELECT date, {r6('ret')} AS ret, names FROM br"))
def _t2(s, d):
    b, pan, dates = X.book_and_panel(s, d)
    return r(AT.basket_return(b, pan, dates=dates), "ret").select("date", "ret", "names")


DAILY = """dz AS (SELECT entry, date, sum(coalesce(close / prev - 1, 0) / n) AS ret FROM (
  SELECT b.date AS entry, b.n, x.date, x.close, lag(x.close) OVER (PARTITION BY b.ticker, b.date ORDER BY x.date) AS prev
  FROM (SELECT *, count(*) OVER (PARTITION BY date) AS n FROM book) b JOIN bd ON bd.date = b.date JOIN bars x ON x.ticker = b.ticker AND x.date > b.date AND x.date <= nd) GROUP BY 1, 2),
dy AS MATERIALIZED (SELECT bd.date AS entry, c.date, coalesce(ret, 0) * 1.1 AS ret FROM bd JOIN (SELECT DISTINCT date FROM bars) c ON c.date > bd.date AND c.date <= nd
  LEFT JOIN dz ON dz.entry = bd.date AND dz.date = c.date)"""


@query("att03_period_daily_returns", with_(*X.BOOK, CHANGES, DAILY, recursive=True, body=f"SELECT entry, date, {r6('ret')} AS ret FROM dy"))
def _t3(s, d):
    bars = cut(A.bars(s, d), "bars")
    b, _, dates = X.book_and_panel(s, d, bars)
    return r(AT.period_daily_returns(b, bars, 1.1, dates=dates), "ret").select("entry", "date", "ret")


@query("att04_charge_costs", with_(*X.BOOK, CHANGES, DAILY, "dr AS (SELECT date AS entry, sum(abs(w1 - w0)) * 0.0015 AS drag FROM chg GROUP BY date)", recursive=True,
    body=f"""SELECT dy.entry, date, {r6('ret - CASE WHEN row_number() OVER (PARTITION BY dy.entry ORDER BY date) = 1 THEN coalesce(drag, 0) ELSE 0 END')} AS net
  FROM dy LEFT JOIN dr ON dr.entry = dy.entry"""))
def _t4(s, d):
    bars = cut(A.bars(s, d), "bars")
    b, _, dates = X.book_and_panel(s, d, bars)
    daily = AT.period_daily_returns(b, bars, 1.1, dates=dates)
    return r(AT.charge_costs(daily, P.cost_drag(P.turnover(b, dates=dates), 0.0015)), "net").select("entry", "date", "net")


SWAPS = "sw AS (SELECT date, count(*) FILTER ((w1 = 0) <> (w0 = 0)) AS k FROM chg GROUP BY date)"


@query("att05_chained_equity", with_(*X.BOOK, CHANGES, BASKET, SWAPS, recursive=True, body=f"""SELECT br.date, {r6('''exp(sum(ln((1 - k * 0.0035 / 10.0) * (1 + ret)))
  OVER (ORDER BY br.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))''')} AS capital FROM (SELECT br.*, coalesce(k, 0) AS k FROM br LEFT JOIN sw ON sw.date = br.date) br"""))
def _t5(s, d):
    return r(equity_of_book(s, d), "capital").select("date", "capital")


def equity_of_book(s, d):
    b, pan, dates = X.book_and_panel(s, d)
    per = AT.basket_return(b, pan, dates=dates).join(AT.swap_counts(b, dates=dates), ["config_id", "date"], "left")
    return AT.chained_equity(per.fillna({"swaps": 0}), 5, 0.0035)


FWD = f"""mb AS MATERIALIZED (SELECT date, ticker, close, lead(close) OVER {over()} / close - 1 AS fwd FROM panel),
mi AS (SELECT date, lead(c) OVER (ORDER BY date) / c - 1 AS bf FROM (SELECT date, avg(close) AS c FROM panel GROUP BY date)),
wt AS (SELECT date, ticker, CASE WHEN slot = 5 THEN -weight ELSE weight END AS weight FROM book),
bd AS (SELECT date, lead(date) OVER (ORDER BY date) AS nd FROM (SELECT DISTINCT date FROM wt)),
od AS (SELECT nd AS date, ticker, weight AS w0 FROM wt JOIN bd USING (date) WHERE nd IS NOT NULL),
chg AS (SELECT coalesce(b.date, od.date) AS date, coalesce(weight, 0) AS w1, coalesce(w0, 0) AS w0 FROM wt b FULL JOIN od ON od.date = b.date AND od.ticker = b.ticker),
co AS (SELECT date, {_COST} AS cost FROM chg GROUP BY date),
po AS (SELECT wt.date, sum(weight * fwd + CASE WHEN weight < 0 THEN -0.003::double / 21 ELSE 0 END) AS pr,
  sum(weight * (cast(substring(wt.ticker, 2, 10) AS bigint) % 5) / 4.0::double) AS beta, sum(abs(weight)) AS gross
  FROM wt JOIN mb ON mb.date = wt.date AND mb.ticker = wt.ticker WHERE fwd IS NOT NULL GROUP BY wt.date),
fa AS MATERIALIZED (SELECT po.date, pr, beta, gross, cost, bf, pr - cost AS net, pr - cost - bf * beta AS alpha FROM po JOIN co ON co.date = po.date JOIN mi ON mi.date = po.date)"""


def forward(s, d):
    pan = X.panel(s, d)
    w = X.book(s, d, pan).withColumn("weight", F.when(F.col("slot") == 5, -F.col("weight")).otherwise(F.col("weight"))).select("config_id", "date", "ticker", "weight")
    betas = A.table(s, d, "supplier").select(A.ticker_of("s_suppkey").alias("ticker"), ((F.col("s_suppkey") % 5) / F.lit(4.0)).alias("beta"))
    return AT.forward_attribution(w, pan, R.synthetic_index(pan), betas)


@query("att06_forward_attribution", with_(*X.BOOK, FWD, recursive=True, body=f"""SELECT date, {r6('pr')} AS portfolio_return, {r6('net')} AS net_return,
  {r6('alpha')} AS alpha, {r6('gross')} AS gross FROM fa"""))
def _t6(s, d):
    return r(forward(s, d), "portfolio_return", "net_return", "alpha", "gross").select("date", "portfolio_return", "net_return", "alpha", "gross")


SPELLS = """stp AS (SELECT date, row_number() OVER (ORDER BY date) AS i, lead(date) OVER (ORDER BY date) AS nd FROM me),
isl AS MATERIALIZED (SELECT b.ticker, b.date, nd, i - row_number() OVER (PARTITION BY b.ticker ORDER BY b.date) AS isl FROM book b JOIN stp ON stp.date = b.date),
sp AS MATERIALIZED (SELECT ticker, isl, min(date) AS entry_date, max(date) AS last_held, arg_max(coalesce(nd, date '1900-01-01'), date) AS xd FROM isl GROUP BY 1, 2),
tr AS MATERIALIZED (SELECT sp.ticker, entry_date, CASE WHEN xd > date '1900-01-01' THEN xd END AS exit_date, CASE WHEN xd > date '1900-01-01' THEN 'CLOSED' ELSE 'OPEN' END AS status,
  e.close AS entry_price, x.close AS exit_price FROM (SELECT *, CASE WHEN xd > date '1900-01-01' THEN xd ELSE last_held END AS mark FROM sp) sp
  JOIN panel e ON e.ticker = sp.ticker AND e.date = entry_date ASOF LEFT JOIN panel x ON x.ticker = sp.ticker AND sp.mark >= x.date)"""


@query("att07_round_trips", with_(*X.BOOK, SPELLS, recursive=True, body=f"""SELECT ticker, entry_date, exit_date, status, {r6('entry_price')} AS entry_price,
  {r6('exit_price')} AS exit_price, {r6('(exit_price / entry_price - 1) * 100')} AS pnl_pct FROM tr"""))
def _t7(s, d):
    b, pan, dates = X.book_and_panel(s, d)
    return r(AT.round_trips(b, pan, dates=dates), "entry_price", "exit_price", "pnl_pct").drop("config_id")


@query("att07_trade_events", with_(*X.BOOK, SPELLS, recursive=True, body="""SELECT isl.date, isl.ticker, CASE WHEN isl.date = entry_date THEN 'BUY' ELSE 'HOLD' END AS action
  FROM isl JOIN sp ON sp.ticker = isl.ticker AND sp.isl = isl.isl UNION ALL SELECT xd, ticker, 'SELL' FROM sp WHERE xd > date '1900-01-01'"""))
def _t7b(s, d):
    b, _, dates = X.book_and_panel(s, d)
    return AT.trade_events(b, dates=dates).select("date", "ticker", "action")


@query("att08_holding_stats", with_(*X.BOOK, SPELLS, recursive=True, body=f"""SELECT count(*) AS trades, {r6('avg(exit_date - entry_date)')} AS avg_days,
  {r6("count(*) / ((max(exit_date) - min(entry_date)) / 365.25::double)")} AS trades_per_year FROM tr WHERE status = 'CLOSED'"""))
def _t8(s, d):
    b, pan, dates = X.book_and_panel(s, d)
    return r(AT.holding_stats(AT.round_trips(b, pan, dates=dates)), "avg_days", "trades_per_year").drop("config_id")


@query("att09_cash_stats", with_(*X.BOOK, "iv AS (SELECT date, sum(weight) AS w FROM book GROUP BY date)", recursive=True, body=f"""SELECT
  {r6('(sum(greatest(1 - w, 0)) + (SELECT count(*) FROM me) - count(*)) / (SELECT count(*) FROM me)')} AS cash_share,
  count(*) FILTER (w = 0) + (SELECT count(*) FROM me) - count(*) AS cash_dates FROM iv"""))
def _t9(s, d):
    return r(AT.cash_stats(X.book(s, d), CAL.month_end_dates(A.bars(s, d))), "cash_share").select("cash_share", "cash_dates")


# ---- metrics

EQ = (BRAND_BARS, X.EQUITY_SQL)
_CAGR = "pow(arg_max(capital, date) / arg_min(capital, date), 1.0::double / ((max(date) - min(date)) / 365.25::double)) - 1"


@query("met01_cagr", with_(*EQ, body=f"SELECT portfolio, {r6(_CAGR)} AS cagr FROM equity GROUP BY 1"))
def _m1(s, d):
    return r(M.cagr(X.brand_equity(s, d)), "cagr")


@query("met02_cagr_rows", with_(*EQ, body=f"SELECT portfolio, {r6('pow(exp(sum(ln(1 + ret))), 252.0::double / count(ret)) - 1')} AS cagr FROM equity GROUP BY 1"))
def _m2(s, d):
    return r(M.cagr_rows(X.brand_equity(s, d)), "cagr")


@query("met03_ann_vol", with_(*EQ, body=f"SELECT portfolio, {r6('stddev_samp(ret) * sqrt(252.0::double)')} AS ann_vol FROM equity GROUP BY 1"))
def _m3(s, d):
    return r(M.ann_vol(X.brand_equity(s, d)), "ann_vol")


_SH = lambda rf, sd, ann=252: f"(avg(ret) - {rf}::double / {ann}) * sqrt({ann}.0::double) / nullif({sd}(ret), 0)"


@query("met04_sharpe", with_(*EQ, body=f"""SELECT portfolio, {r6(_SH(0.06, 'stddev_samp'))} AS rf6, {r6(f"CASE WHEN count(ret) < 1500 THEN -999 ELSE {_SH(0.065, 'stddev_samp')} END")} AS rf65,
  {r6(_SH(0.0, 'stddev_pop'))} AS rf0_pop, {r6(_SH(0.0, 'stddev_samp'))} AS rf0 FROM equity GROUP BY 1"""))
def _m4(s, d):
    e = X.brand_equity(s, d)
    out = e.groupBy("portfolio").agg(
        M.sharpe_of("ret", 0.06).alias("rf6"), M.sharpe_of("ret", 0.065, min_rows=1500, sentinel=-999.0).alias("rf65"),
        M.sharpe_of("ret", 0.0, 0).alias("rf0_pop"), M.sharpe_of("ret", 0.0, 1).alias("rf0"))
    return r(out, "rf6", "rf65", "rf0_pop", "rf0")


@query("met05_sortino", with_(*EQ, body=f"SELECT portfolio, {r6('(avg(ret) - 0.06::double / 252) * sqrt(252.0::double) / stddev_samp(CASE WHEN ret < 0 THEN ret END)')} AS sortino FROM equity GROUP BY 1"))
def _m5(s, d):
    return r(M.sortino(X.brand_equity(s, d)), "sortino")


_PK = run("portfolio")


@query("met06_max_drawdown", with_(*EQ, f"dd AS (SELECT portfolio, capital / max(capital) OVER {_PK} - 1 AS a, capital / greatest(max(capital) OVER {_PK}, 1200) - 1 AS b FROM equity)",
    body=f"SELECT portfolio, {r6('min(a) * 100')} AS max_drawdown, {r6('min(b) * 100')} AS from_base FROM dd GROUP BY 1"))
def _m6(s, d):
    e = X.brand_equity(s, d)
    base = M.max_drawdown(e, 1200.0).withColumnRenamed("max_drawdown", "from_base")
    return r(M.max_drawdown(e).join(base, "portfolio"), "max_drawdown", "from_base")


@query("met07_max_drawdown_abs", with_(PRICED, PNL_SQL, """dp AS (SELECT strategy, date, sum(pnl) AS pnl FROM pnl GROUP BY 1, 2),
cu AS (SELECT strategy, date, sum(pnl) OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM dp),
dd AS (SELECT strategy, c - max(c) OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d FROM cu)""",
    body=f"SELECT strategy, {r6('min(d)', 2)} AS max_drawdown FROM dd GROUP BY 1"))
def _m7(s, d):
    """Daily P&L first, so the running sums see one row per strategy and day."""
    daily = sell_pnl(s, d).groupBy("strategy", "date").agg(F.sum("pnl").alias("pnl"))
    return r(M.max_drawdown_abs(daily, ("strategy",)), "max_drawdown", places=2)


@query("met08_trade_stats", with_(PRICED, PNL_SQL, body=f"""SELECT strategy, count(pnl) AS trades, {r6('count(*) FILTER (pnl > 0) / count(pnl)::double * 100')} AS win_rate,
  {r6('avg(CASE WHEN pnl > 0 THEN pnl END)', 4)} AS avg_win, {r6('avg(CASE WHEN pnl < 0 THEN pnl END)', 4)} AS avg_loss,
  {r6('sum(CASE WHEN pnl > 0 THEN pnl END) / abs(sum(CASE WHEN pnl < 0 THEN pnl END))')} AS profit_factor, {r6('avg(pnl)', 4)} AS expectancy FROM pnl GROUP BY 1"""))
def _m8(s, d):
    return r(r(M.trade_stats(sell_pnl(s, d), keys=("strategy",)), "win_rate", "profit_factor"), "avg_win", "avg_loss", "expectancy", places=4)


_Y, _XX = "(ret - 0.06::double / 252)", "(mkt_ret - 0.06::double / 252)"
CAPM_SQL = f"""capm AS MATERIALIZED (SELECT portfolio, regr_slope({_Y}, {_XX}) AS beta, regr_intercept({_Y}, {_XX}) * 252 AS alpha_annual, pow(corr({_Y}, {_XX}), 2) AS r2,
  corr({_Y}, {_XX}) AS corr, sqrt((1 - pow(corr({_Y}, {_XX}), 2)) * var_samp({_Y}) / var_samp({_XX}) / (count(*) - 2)) AS beta_stderr, count(*) AS n FROM joined GROUP BY 1)"""


@query("met09_capm", with_(*X.JOINED, CAPM_SQL, body="SELECT portfolio, n, " + ", ".join(f"{r6(c)} AS {c}" for c in ("beta", "alpha_annual", "r2", "corr", "beta_stderr")) + " FROM capm"))
def _m9(s, d):
    return r(M.capm(X.joined(s, d)), "beta", "alpha_annual", "r2", "corr", "beta_stderr")


_CP = lambda c: f"avg(CASE WHEN mkt_ret {c} 0 THEN ret END) / avg(CASE WHEN mkt_ret {c} 0 THEN mkt_ret END) * 100"


@query("met10_capture", with_(*X.JOINED, body=f"SELECT portfolio, {r6(_CP('>'))} AS up_capture, {r6(_CP('<'))} AS down_capture FROM joined GROUP BY 1"))
def _m10(s, d):
    return r(M.capture(X.joined(s, d)), "up_capture", "down_capture")


@query("met11_tracking", with_(*X.JOINED, body=f"""SELECT portfolio, {r6('stddev_samp(ret - mkt_ret) * sqrt(252.0::double)')} AS tracking_error,
  {r6('avg(ret - mkt_ret) * 252 / (stddev_samp(ret - mkt_ret) * sqrt(252.0::double))')} AS information_ratio FROM joined GROUP BY 1"""))
def _m11(s, d):
    return r(M.tracking(X.joined(s, d)), "tracking_error", "information_ratio")


@query("met12_vol_split", with_(*X.JOINED, CAPM_SQL, body=f"""SELECT portfolio, {r6('stddev_samp(ret) * sqrt(252.0::double)')} AS total_vol,
  {r6('abs(any_value(beta)) * stddev_samp(mkt_ret) * sqrt(252.0::double)')} AS systematic_vol, {r6('stddev_samp(ret - beta * mkt_ret) * sqrt(252.0::double)')} AS idiosyncratic_vol
  FROM joined JOIN capm USING (portfolio) GROUP BY 1"""))
def _m12(s, d):
    j = X.joined(s, d)
    return r(M.vol_split(j, M.capm(j)), "total_vol", "systematic_vol", "idiosyncratic_vol")


@query("met13_r2_verdict", with_(*X.JOINED, CAPM_SQL, body="""SELECT portfolio, CASE WHEN r2 < 0.15 THEN 'pure alpha' WHEN r2 < 0.40 THEN 'alpha dominant'
  WHEN r2 < 0.65 THEN 'mixed' ELSE 'beta driven' END AS verdict FROM capm"""))
def _m13(s, d):
    return M.r2_verdict(M.capm(X.joined(s, d))).select("portfolio", "verdict")


@query("met14_monthly_corr", with_(*X.JOINED, "mo AS (SELECT portfolio, date_trunc('month', date) AS m, exp(sum(ln(1 + ret))) - 1 AS a, exp(sum(ln(1 + mkt_ret))) - 1 AS b FROM joined GROUP BY 1, 2)",
    body=f"SELECT portfolio, {r6('corr(a, b)')} AS monthly_corr, count(*) AS months FROM mo GROUP BY 1"))
def _m14(s, d):
    return r(M.monthly_corr(X.joined(s, d)), "monthly_corr")


@query("met15_annual_table", with_(*EQ, """dd AS (SELECT portfolio, date, capital, year(date) AS y, capital / max(capital) OVER (PARTITION BY portfolio, year(date) ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS d FROM equity)""", body=f"""SELECT portfolio, cast(y AS int) AS year,
  {r6('arg_max(capital, date) / arg_min(capital, date) - 1')} AS ret, {r6('min(d)')} AS max_drawdown FROM dd GROUP BY 1, 2"""))
def _m15(s, d):
    return r(M.annual_table(X.brand_equity(s, d)), "ret", "max_drawdown")


_RG = "(ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("met16_weekly_summary", with_(*X.BOOK, FWD, f"gr AS (SELECT *, exp(sum(ln(1 + net)) OVER {_RG}) AS g FROM fa WHERE bf IS NOT NULL)",
    f"gd AS (SELECT *, g / max(g) OVER {_RG} - 1 AS dd FROM gr)", recursive=True, body=f"""SELECT count(*) AS periods, {r6('exp(sum(ln(1 + net))) - 1')} AS total_return,
  {r6('avg(net) * 12')} AS annual_return, {r6('stddev_samp(net) * sqrt(12.0::double)')} AS annual_vol, {r6('avg(net) * sqrt(12.0::double) / stddev_samp(net)')} AS sharpe,
  {r6('avg(alpha) * 12')} AS annual_alpha, {r6('avg(alpha) * sqrt(12.0::double) / stddev_samp(alpha)')} AS information_ratio, {r6('regr_slope(net, bf)')} AS beta,
  {r6('min(dd)')} AS max_drawdown, {r6('count(*) FILTER (net > 0) / count(*)::double')} AS hit_rate, {r6('avg(cost)')} AS avg_cost, {r6('avg(gross)')} AS avg_gross,
  {r6('exp(sum(ln(1 + bf))) - 1')} AS benchmark_total FROM gd"""))
def _m16(s, d):
    w = M.weekly_summary(forward(s, d).where("bench_fwd is not null"), 12, ("config_id",)).drop("config_id")
    return r(w, *[c for c in w.columns if c != "periods"])


@query("met17_relative_growth", with_(*X.JOINED, body=f"SELECT portfolio, date, {r6(f'exp(sum(ln(1 + ret)) OVER {_PK}) / exp(sum(ln(1 + mkt_ret)) OVER {_PK})')} AS relative FROM joined"))
def _m17(s, d):
    return r(M.relative_growth(X.joined(s, d)), "relative").select("portfolio", "date", "relative")


@query("met18_compare_scenarios", with_(*X.JOINED, body=f"""SELECT portfolio, 'sharpe' AS metric, {r6(_SH(0.0, 'stddev_samp'))} AS both_sides,
  {r6("(avg(greatest(ret, 0)) - 0) * sqrt(252.0::double) / nullif(stddev_samp(greatest(ret, 0)), 0)")} AS long_only FROM joined GROUP BY 1
  UNION ALL SELECT portfolio, 'vol', {r6('stddev_samp(ret)')}, {r6('stddev_samp(greatest(ret, 0))')} FROM joined GROUP BY 1"""))
def _m18(s, d):
    j = X.joined(s, d)
    summ = lambda df: df.groupBy("portfolio").agg(M.sharpe_of("ret", 0.0).alias("sharpe"), F.stddev_samp("ret").alias("vol"))
    pos = j.withColumn("ret", F.greatest("ret", F.lit(0.0)))
    return r(M.compare_scenarios({"both_sides": summ(j), "long_only": summ(pos)}, ["sharpe", "vol"]), "both_sides", "long_only")


_SEG = f"""sg AS (SELECT *, CASE WHEN date < date '1999-01-01' THEN 'train' ELSE 'test' END AS segment FROM joined),
sgg AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio, segment ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS g FROM sg),
sgd AS (SELECT *, g / max(g) OVER (PARTITION BY portfolio, segment ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM sgg),
sm AS MATERIALIZED (SELECT portfolio, segment, exp(sum(ln(1 + ret))) - 1 AS total_return, pow(exp(sum(ln(1 + ret))), 252.0::double / count(ret)) - 1 AS cagr,
  {_SH(0.0, 'stddev_pop')} AS sharpe, min(dd) AS max_drawdown, count(*) AS rows FROM sgd GROUP BY 1, 2)"""


@query("met19_oos_degradation", with_(*X.JOINED, _SEG, body=f"""SELECT a.portfolio, {r6('a.sharpe')} AS is_sharpe, {r6('b.sharpe')} AS oos_sharpe, {r6('b.sharpe / a.sharpe', 4)} AS sharpe_kept,
  {r6('b.cagr - a.cagr')} AS cagr_change FROM sm a JOIN sm b ON a.portfolio = b.portfolio AND a.segment = 'train' AND b.segment = 'test'"""))
def _m19(s, d):
    return r(r(M.oos_degradation(X.joined(s, d), "1999-01-01"), "is_sharpe", "oos_sharpe", "cagr_change"), "sharpe_kept", places=4)


@query("met20_split_metrics", with_(*X.JOINED, _SEG, body="SELECT portfolio, segment, rows, " + ", ".join(f"{r6(c)} AS {c}" for c in ("total_return", "cagr", "sharpe", "max_drawdown")) + " FROM sm"))
def _m20(s, d):
    return r(M.split_metrics(X.joined(s, d), "1999-01-01"), "total_return", "cagr", "sharpe", "max_drawdown")
