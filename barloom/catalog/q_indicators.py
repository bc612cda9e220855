"""Indicator queries over supplier bars."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import indicators as I
from ..operators import regime as R
from ..sources import adapters as A
from .base import (BARS, BRAND_BARS, INDEX, frame, lagx, over, query, r6, ret_sql, roll, run, with_,
                   regime_sql)


def _out(df, *cols, places=6):
    return df.select("ticker", "date", *[rnd(c, places).alias(c) for c in cols])


def _sel(**cols):
    return "SELECT ticker, date, " + ", ".join(f"{r6(x)} AS {n}" for n, x in cols.items()) + " FROM bars"


def _simple(name, build, *, places=6, **cols):
    sql = with_(BARS, body="SELECT ticker, date, "
                + ", ".join(f"{r6(x, places)} AS {n}" for n, x in cols.items()) + " FROM bars")

    @query(name, sql)
    def _(s, d):
        return _out(build(A.bars(s, d)), *cols, places=places)


_simple("ind01_lag_lead", lambda b: I.lag_n(I.lag_n(b, "close", 21), "open", -1),
        close_lag21=lagx("close", 21), open_lead1=f"lead(open) OVER {over()}")


@query("ind02_returns", with_(BARS, body=_sel(
    **{f"ret{n}": ret_sql(n) for n in (1, 5, 21, 63, 126, 252)})))
def _returns(s, d):
    b = A.bars(s, d)
    for n in (1, 5, 21, 63, 126, 252):
        b = I.ret_n(b, n)
    return _out(b, *[f"ret{n}" for n in (1, 5, 21, 63, 126, 252)])


_simple("ind03_log_return", I.log_ret, log_ret=f"ln(close / {lagx('close')})")
_simple("ind04_sma", lambda b: I.sma(I.sma(I.sma(b, n=50), n=100), n=200),
        sma50=roll("avg", "close", 50), sma100=roll("avg", "close", 100), sma200=roll("avg", "close", 200))
_simple("ind04_sma_min_periods", lambda b: I.sma(b, n=100, min_periods=1), sma100=roll("avg", "close", 100, 1))

_RET = f"r AS (SELECT *, {ret_sql()} AS r FROM bars)"


@query("ind05_realized_vol", with_(BARS, _RET, body=f"""SELECT ticker, date,
  {r6(roll('stddev_samp', 'r', 20) + ' * sqrt(252.0::double)')} AS vol20,
  {r6(roll('stddev_samp', 'r', 60) + ' * sqrt(252.0::double)')} AS vol60 FROM r"""))
def _vol(s, d):
    return _out(I.realized_vol(I.realized_vol(A.bars(s, d), 20), 60), "vol20", "vol60")


_simple("ind06_avg_turnover", I.avg_turnover, places=4, avg_turnover20=roll("avg", "close * volume", 20))
_simple("ind07_avg_volume", I.avg_volume, avg_volume5=roll("avg", "volume", 5))
_simple("ind08_turnover_ratio", I.turnover_ratio,
        turnover_ratio20=f"close * volume / nullif({roll('avg', 'close * volume', 20)}, 0)")
_simple("ind09_price_to_sma", lambda b: I.price_to_sma(I.price_to_sma(b, 50), 200),
        price_to_sma50=f"close / nullif({roll('avg', 'close', 50)}, 0)",
        price_to_sma200=f"close / nullif({roll('avg', 'close', 200)}, 0)")
_simple("ind10_momentum_12_1", I.momentum, mom=f"{lagx('close', 21)} / nullif({lagx('close', 252)}, 0) - 1")
_simple("ind11_momentum_n", lambda b: I.momentum(b, 126, 0), mom=f"close / nullif({lagx('close', 126)}, 0) - 1")


@query("ind12_risk_adjusted_momentum", with_(
    BARS, _RET, f"""m AS (SELECT ticker, date, {lagx('close', 21)} / nullif({lagx('close', 252)}, 0) - 1 AS mom,
  {roll('stddev_samp', 'r', 60)} * sqrt(252.0::double) AS vol60 FROM r)""",
    body=f"""SELECT ticker, date, {r6('coalesce(mom / (vol60 + 0.000001::double), mom)')} AS screener,
  {r6('mom / coalesce(nullif(vol60, 0), 0.20::double)')} AS matrix, {r6('mom / nullif(vol60, 0)')} AS ratio FROM m"""))
def _ram(s, d):
    b = I.momentum(I.realized_vol(A.bars(s, d), 60))
    for v in ("screener", "matrix", "ratio"):
        b = I.risk_adj_momentum(b, v).withColumnRenamed("risk_adj_mom", v)
    return _out(b, "screener", "matrix", "ratio")


_DIFF = f"df AS (SELECT *, close - {lagx('close')} AS d FROM bars)"


@query("ind13_rsi", with_(BARS, _DIFF, f"""g AS (SELECT ticker, date,
  {roll('avg', 'CASE WHEN d IS NOT NULL THEN greatest(d, 0.0::double) END', 14)} AS g,
  {roll('avg', 'CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0::double) END', 14)} AS l FROM df)""",
    body=f"SELECT ticker, date, {r6('100.0 - 100.0 / (1.0 + g / (l + 1e-10::double))')} AS rsi14 FROM g"))
def _rsi(s, d):
    return _out(I.rsi(A.bars(s, d)), "rsi14")


@query("ind14_atr", with_(BARS, f"""t AS (SELECT ticker, date,
  greatest(high - low, abs(high - {lagx('close')}), abs(low - {lagx('close')})) AS tr FROM bars)""",
    body=f"SELECT ticker, date, {r6('tr')} AS tr, {r6(roll('avg', 'tr', 14))} AS atr14 FROM t"))
def _atr(s, d):
    return _out(I.atr(A.bars(s, d)), "tr", "atr14")


_simple("ind15_exec_gap", I.exec_gap, exec_gap=f"lead(open) OVER {over()} / close - 1")


@query("ind16_drawdown", with_(BARS, body=f"""SELECT ticker, date, {r6('max(close) OVER ' + run())} AS peak,
  {r6(f'close / (max(close) OVER {run()}) - 1')} AS drawdown FROM bars"""))
def _dd(s, d):
    return _out(I.drawdown(A.bars(s, d), "close"), "peak", "drawdown")


@query("ind17_growth", with_(BARS, _RET, body=f"""SELECT ticker, date,
  {r6('exp(sum(ln(1 + coalesce(r, 0))) OVER ' + run() + ')')} AS growth FROM r"""))
def _growth(s, d):
    return _out(I.growth(I.ret_n(A.bars(s, d), 1), "ret1"), "growth")


_MKT = f"""i AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS mkt FROM idx),
j AS (SELECT r.ticker, r.date, r.r, i.mkt FROM r LEFT JOIN i ON r.date = i.date)"""


def _vs_market(s, d):
    b = A.brand_bars(s, d)
    idx = R.synthetic_index(b)
    m = idx.withColumn("mkt", I.div("close", I.lag("close", 1, "index_id")) - 1).select("date", "mkt")
    return I.ret_n(b, 1).join(m, "date", "left")


def _pairs_full(n):
    f = frame(n)
    return f"count(CASE WHEN r IS NOT NULL AND mkt IS NOT NULL THEN 1 END) OVER {f} = {n}"


def _beta_sql(n):
    f = frame(n)
    return (f"CASE WHEN {_pairs_full(n)} THEN (covar_samp(r, mkt) OVER {f}) / "
            f"nullif(var_samp(CASE WHEN r IS NOT NULL THEN mkt END) OVER {f}, 0) END")


@query("ind18_rolling_beta", with_(BRAND_BARS, INDEX, _RET, _MKT, body=f"""SELECT ticker, date,
  {r6(_beta_sql(63))} AS beta63, {r6(_beta_sql(126))} AS beta126 FROM j"""))
def _beta(s, d):
    v = _vs_market(s, d)
    return _out(I.rolling_beta(I.rolling_beta(v, "ret1", "mkt", 63), "ret1", "mkt", 126), "beta63", "beta126")


@query("ind19_rolling_corr", with_(BRAND_BARS, INDEX, _RET, _MKT, body=f"""SELECT ticker, date,
  {r6(f"CASE WHEN {_pairs_full(63)} THEN corr(r, mkt) OVER {frame(63)} END")} AS corr63 FROM j"""))
def _corr(s, d):
    return _out(I.rolling_corr(_vs_market(s, d), "ret1", "mkt", 63), "corr63")


_B20 = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_BREAK = f"coalesce(count(high) OVER {_B20} = 20 AND close > max(high) OVER {_B20}, false)"


@query("ind20_breakout", with_(BARS, body=f"SELECT ticker, date, {_BREAK} AS breakout FROM bars"))
def _breakout(s, d):
    return I.breakout(A.bars(s, d)).select("ticker", "date", "breakout")


_BBW = f"bw AS (SELECT *, 4.0 * ({roll('stddev_samp', 'close', 20)}) / nullif({roll('avg', 'close', 20)}, 0) AS bbw FROM bars)"
_BBM = f"bm AS (SELECT *, CASE WHEN count(bbw) OVER {frame(50)} >= 50 THEN quantile_cont(bbw, 0.5) OVER {frame(50)} END AS bbm FROM bw)"


@query("ind21_contraction", with_(BARS, _BBW, _BBM, body=f"""SELECT ticker, date, {r6('bbw')} AS bb_width,
  {r6('bbm')} AS bb_median FROM bm"""))
def _contraction(s, d):
    return _out(I.contraction(A.bars(s, d)), "bb_width", "bb_median")


_VHF = f"({roll('max', 'close', 28)} - {roll('min', 'close', 28)}) / nullif({roll('sum', 'ad', 28)}, 0)"
_ABSD = f"ad AS (SELECT *, abs(close - {lagx('close')}) AS ad FROM bars)"


@query("ind22_vhf", with_(BARS, _ABSD, body=f"SELECT ticker, date, {r6(_VHF)} AS vhf28 FROM ad"))
def _vhf(s, d):
    return _out(I.vhf(A.bars(s, d)), "vhf28")


_KAMA = f"""k0 AS MATERIALIZED (SELECT ticker, date, close, row_number() OVER {over()} AS rn,
    {lagx('close', 10)} AS c10, {roll('sum', 'ad', 10)} AS vol10 FROM ad),
k1 AS MATERIALIZED (SELECT *, pow(coalesce(abs(close - c10) / nullif(vol10, 0), 0) * (2.0::double / 3.0 - 2.0::double / 31.0)
    + 2.0::double / 31.0, 2) AS c FROM k0),
kk AS (SELECT ticker, date, rn, close AS kama FROM k1 WHERE rn = 11
  UNION ALL SELECT k1.ticker, k1.date, k1.rn, kk.kama + k1.c * (k1.close - kk.kama)
  FROM kk JOIN k1 ON k1.ticker = kk.ticker AND k1.rn = kk.rn + 1)"""


@query("ind23_kama", with_(BARS, _ABSD, _KAMA, recursive=True, body=f"""SELECT k0.ticker, k0.date, {r6('kama')} AS kama
  FROM k0 LEFT JOIN kk ON k0.ticker = kk.ticker AND k0.rn = kk.rn"""))
def _kama(s, d):
    return _out(I.kama(A.bars(s, d)), "kama")


_simple("ind24_rolling_z", I.rolling_z,
        z252=f"(close - {roll('avg', 'close', 252)}) / nullif({roll('stddev_samp', 'close', 252)}, 0)")


def _full_indicators(b):
    b = I.rolling_z(I.vhf(I.contraction(I.breakout(b))))
    b = I.avg_volume(I.avg_turnover(I.sma(b, n=200)), 20)
    return I.kama(b)


@query("ind25_breakout_entry", with_(
    BARS, regime_sql(), _ABSD, _KAMA, _BBW, _BBM,
    f"""ind AS (SELECT bm.ticker, bm.date, bm.close, bm.volume, {_BREAK} AS breakout,
  coalesce(bbw < bbm, false) AS contraction,
  (bm.close - {roll('avg', 'bm.close', 252)}) / nullif({roll('stddev_samp', 'bm.close', 252)}, 0) AS z252,
  {roll('avg', 'bm.close', 200)} AS sma200, {roll('avg', 'bm.close * bm.volume', 20)} AS avg_turnover20,
  {roll('avg', 'bm.volume', 20)} AS avg_volume20 FROM bm)""".replace("PARTITION BY ticker ORDER BY date", "PARTITION BY bm.ticker ORDER BY bm.date"),
    f"vh AS (SELECT ticker, date, {_VHF} AS vhf28 FROM ad)",
    recursive=True,
    body="""SELECT ind.ticker, ind.date,
  cast(ind.breakout AS int) + cast(contraction AS int) + cast(coalesce(vhf28 > 0.20, false) AS int)
  + cast(coalesce(ind.close > kama, false) AS int) + cast(coalesce(z252 > 0, false) AS int)
  + cast(coalesce(ind.close > sma200, false) AS int) + cast(coalesce(volume > avg_volume20, false) AS int)
  + cast(coalesce(ind.close > 10 AND avg_turnover20 > 20000, false) AS int) + cast(coalesce(bullish, false) AS int)
  AS conditions_met
  FROM ind LEFT JOIN vh ON vh.ticker = ind.ticker AND vh.date = ind.date
  LEFT JOIN kk ON kk.ticker = ind.ticker AND kk.date = ind.date
  LEFT JOIN regime ON regime.date = ind.date"""))
def _entry(s, d):
    b = A.bars(s, d)
    reg = R.market_regime(R.synthetic_index(b))
    return I.breakout_entry(_full_indicators(b), reg).select("ticker", "date", "conditions_met")


@query("ind26_edges", with_(BARS, f"f AS (SELECT ticker, date, {_BREAK} AS breakout FROM bars)", body=f"""
  SELECT ticker, date, breakout AND NOT coalesce({lagx('breakout')}, false) AS breakout_edge FROM f"""))
def _edges(s, d):
    return I.edges(I.breakout(A.bars(s, d)), "breakout").select("ticker", "date", "breakout_edge")


@query("ind27_single_name_flags", with_(
    BARS, regime_sql(), f"""m AS (SELECT ticker, date, coalesce(close > {roll('avg', 'close', 200)}, false) AS trend,
  {lagx('close', 21)} / nullif({lagx('close', 252)}, 0) - 1 AS mom FROM bars)""",
    """f AS (SELECT m.ticker, m.date, coalesce(bullish, false) AND trend AND coalesce(mom > 0, false) AS full_buy,
  NOT coalesce(bullish, false) AND trend AND coalesce(mom > 0.20, false) AS bear_buy
  FROM m LEFT JOIN regime ON m.date = regime.date)""",
    body="SELECT ticker, date, full_buy, bear_buy, NOT full_buy AND NOT bear_buy AS cash FROM f"))
def _flags(s, d):
    b = A.bars(s, d)
    ind = I.momentum(I.sma(b, n=200))
    return I.single_name_flags(ind, R.market_regime(R.synthetic_index(b))).select(
        "ticker", "date", "full_buy", "bear_buy", "cash")


@query("ind28_return_sequence", with_(BARS, _RET, f"""q AS (SELECT ticker, date, CASE WHEN count(r) OVER {frame(21)} = 21
  THEN list(r) OVER {frame(21)} END AS seq FROM r)""", body=f"""
  SELECT ticker, date, len(seq) AS n, {r6('seq[1]')} AS oldest, {r6('seq[21]')} AS newest,
  {r6('list_sum(seq)')} AS total FROM q"""))
def _seq(s, d):
    q = I.return_sequence(A.bars(s, d))
    return q.select("ticker", "date", F.when(F.col("seq").isNotNull(), F.size("seq")).cast("long").alias("n"),
                    rnd(F.get("seq", F.lit(0))).alias("oldest"), rnd(F.get("seq", F.lit(20))).alias("newest"),
                    rnd(F.aggregate("seq", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("ind29_limit_move", with_(BARS, _RET, body=f"""SELECT ticker, date,
  coalesce(max(abs(r)) OVER {frame(4)} > 0.09, false) AS limit_move FROM r"""))
def _limit(s, d):
    return I.limit_move(A.bars(s, d)).select("ticker", "date", "limit_move")


@query("ind30_monthly_compound", with_(BARS, _RET, body=f"""SELECT ticker, cast(date_trunc('month', date) AS date) AS month,
  {r6('exp(sum(ln(1 + coalesce(r, 0)))) - 1')} AS month_ret FROM r GROUP BY 1, 2"""))
def _monthly(s, d):
    return I.monthly_compound(I.ret_n(A.bars(s, d), 1), "ret1").select(
        "ticker", "month", rnd("month_ret").alias("month_ret"))
