"""Aggregation and ranking queries."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..functions.orderstats import pct_rank, quantiles
from ..operators import aggregates as G
from ..operators import indicators as I
from ..operators import joins as J
from ..operators import rank as K
from ..operators import regime as R
from ..sources import adapters as A
from . import frames as X
from .base import BARS, BRAND_BARS, INDEX, PRICED, SECTORS, TRADES, key_sql, over, query, r6, ret_sql, with_
from .q_regime import SIGNALS_SQL, STATE_SQL, raw_signals


def with_sector(s, d, df):
    return J.lookup(df, A.sector_map(s, d), "ticker", "sector", "Other")


@query("agg01_group_mean", with_(BARS, SECTORS, body=f"""SELECT date, sector, {r6('avg(close)')} AS mean_close FROM bars JOIN sectors USING (ticker) GROUP BY 1, 2"""))
def _a1(s, d):
    return G.group_mean(with_sector(s, d, A.bars(s, d)), ["date", "sector"], "close").withColumn("mean_close", rnd("mean_close"))


@query("agg02_median_mad", with_(BARS, X.PANEL_SQL, """m AS (SELECT date, median(ret5) AS med, stddev_samp(ret5) AS sd FROM panel WHERE ret5 IS NOT NULL GROUP BY date),
q AS (SELECT p.date, median(abs(ret5 - med)) AS mad FROM panel p JOIN m ON m.date = p.date WHERE ret5 IS NOT NULL GROUP BY p.date)""",
    body=f"SELECT m.date, {r6('med')} AS median, {r6('CASE WHEN mad <> 0 THEN mad ELSE sd END')} AS mad FROM m JOIN q ON m.date = q.date"))
def _a2(s, d):
    return G.median_mad(X.panel(s, d), ["date"], "ret5").select("date", rnd("median").alias("median"), rnd("mad").alias("mad"))


_Q = {"q05": 0.05, "q25": 0.25, "q75": 0.75, "q95": 0.95}


@query("agg03_quantiles", with_(BARS, SECTORS, f"r AS (SELECT ticker, {ret_sql()} AS r FROM bars)", body="SELECT sector, " + ", ".join(
    f"{r6(f'quantile_cont(r, {q})')} AS {n}" for n, q in _Q.items()) + " FROM r JOIN sectors USING (ticker) WHERE r IS NOT NULL GROUP BY sector"))
def _a3(s, d):
    """Five sectors hold all rows: each is ranked in value ranges, not in one task."""
    q = quantiles(with_sector(s, d, I.ret_n(A.bars(s, d), 1)), ["sector"], "ret1", _Q)
    return q.select("sector", *[rnd(n).alias(n) for n in _Q])


@query("agg04_first_last", with_(BARS, body=f"""SELECT ticker, cast(year(date) AS int) AS year, {r6('arg_min(close, date)')} AS first, {r6('arg_max(close, date)')} AS last
  FROM bars GROUP BY 1, 2"""))
def _a4(s, d):
    b = A.bars(s, d).withColumn("year", F.year("date"))
    return G.first_last(b, ["ticker", "year"], "close").withColumn("first", rnd("first")).withColumn("last", rnd("last"))


@query("agg05_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _a5(s, d):
    return G.value_counts(A.table(s, d, "events"), "event_type")


def sell_pnl(s, d):
    """Sales valued against the retail price of the day's line: a P&L per trade."""
    t = A.trades(s, d)
    return t.withColumn("pnl", F.when(F.col("side") == "sell", F.col("qty")).otherwise(-F.col("qty")) * (F.col("price") - 950.0))


PNL_SQL = TRADES + """,
pnl AS MATERIALIZED (SELECT *, CASE WHEN side = 'sell' THEN qty ELSE -qty END * (price - 950) AS pnl FROM trades)"""


@query("agg06_win_loss_sums", with_(PRICED, PNL_SQL, body=f"""SELECT strategy, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses,
  {r6('sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END)', 2)} AS gross_profit, {r6('sum(CASE WHEN pnl < 0 THEN pnl ELSE 0 END)', 2)} AS gross_loss FROM pnl GROUP BY 1"""))
def _a6(s, d):
    return G.win_loss_sums(sell_pnl(s, d)).withColumn("gross_profit", rnd("gross_profit", 2)).withColumn("gross_loss", rnd("gross_loss", 2))


@query("agg07_exposure_totals", with_(BARS, STATE_SQL, SIGNALS_SQL, body=f"""SELECT {r6('sum(abs(position))')} AS gross, {r6('sum(position)')} AS net,
  {r6('sum(position * 1.5)')} AS beta_exposure, count(*) FILTER (position > 0.001) AS longs, count(*) FILTER (position < -0.001) AS shorts FROM sig"""))
def _a7(s, d):
    t = G.exposure_totals(raw_signals(s, d).withColumn("beta", F.lit(1.5)))
    return t.select(rnd("gross").alias("gross"), rnd("net").alias("net"), rnd("beta_exposure").alias("beta_exposure"), "longs", "shorts")


@query("agg08_sector_exposure", with_(BARS, SECTORS, STATE_SQL, SIGNALS_SQL, body=f"SELECT sector, {r6('sum(position)')} AS exposure FROM sig JOIN sectors USING (ticker) GROUP BY 1"))
def _a8(s, d):
    return G.sector_exposure(raw_signals(s, d), A.sector_map(s, d)).withColumn("exposure", rnd("exposure"))


@query("agg09_monthly_sum", with_(PRICED, PNL_SQL, body=f"SELECT strategy, cast(date_trunc('month', date) AS date) AS month, {r6('sum(pnl)', 2)} AS total FROM pnl GROUP BY 1, 2"))
def _a9(s, d):
    return G.monthly_sum(sell_pnl(s, d), "pnl", keys=("strategy",)).withColumn("total", rnd("total", 2))


@query("agg10_month_end_change", with_(BRAND_BARS, X.EQUITY_SQL, """m AS (SELECT portfolio, cast(date_trunc('month', date) AS date) AS month, arg_max(capital, date) AS capital FROM equity GROUP BY 1, 2)""",
    body=f"""SELECT portfolio, month, {r6('capital')} AS capital, {r6('(capital / coalesce(lag(capital) OVER (PARTITION BY portfolio ORDER BY month), 1000) - 1) * 100')} AS capital_change FROM m"""))
def _a10(s, d):
    return G.month_end_change(X.brand_equity(s, d), ["capital"], 1000.0).withColumn("capital", rnd("capital")).withColumn("capital_change", rnd("capital_change"))


@query("agg11_ols", with_(*X.JOINED, body=f"""SELECT portfolio, {r6('regr_slope(ret, mkt_ret)')} AS slope, {r6('regr_intercept(ret, mkt_ret)')} AS intercept,
  {r6('regr_r2(ret, mkt_ret)')} AS r2, {r6('covar_samp(ret, mkt_ret)', 9)} AS cov, {r6('var_samp(mkt_ret)', 9)} AS var_x, regr_count(ret, mkt_ret) AS n FROM joined GROUP BY 1"""))
def _a11(s, d):
    o = G.ols_agg(X.joined(s, d), "ret", "mkt_ret", ["portfolio"])
    return o.select("portfolio", *[rnd(c).alias(c) for c in ("slope", "intercept", "r2")], rnd("cov", 9).alias("cov"), rnd("var_x", 9).alias("var_x"), "n")


@query("agg12_sector_stats", with_(BARS, SECTORS, STATE_SQL, SIGNALS_SQL, body=f"""SELECT sector, count(*) AS names, {r6('avg(position)')} AS avg_score,
  count(*) FILTER (position > 0) AS positive FROM sig JOIN sectors USING (ticker) GROUP BY 1"""))
def _a12(s, d):
    return G.sector_stats(with_sector(s, d, raw_signals(s, d)), "position").withColumn("avg_score", rnd("avg_score"))


@query("agg13_pivot_metric", with_(BRAND_BARS, X.EQUITY_SQL, body="SELECT portfolio, " + ", ".join(
    f"{r6(f'max(CASE WHEN y = {y} THEN capital END)')} AS y{y}" for y in (1998, 1999, 2000)) + """ FROM (
  SELECT portfolio, year(date) AS y, arg_max(capital, date) AS capital FROM equity GROUP BY 1, 2) GROUP BY 1"""))
def _a13(s, d):
    e = X.brand_equity(s, d).groupBy("portfolio", F.year("date").alias("y")).agg(F.max_by("capital", "date").alias("capital"))
    p = G.pivot_metric(e, "portfolio", "y", "capital", [1998, 1999, 2000])
    return p.select("portfolio", *[rnd(F.col(f"`{y}`")).alias(f"y{y}") for y in (1998, 1999, 2000)])


# ---- ranking

@query("rnk01_top_n", with_(BARS, X.PANEL_SQL, X.RANKED_SQL, body=f"SELECT date, ticker, rank, {r6('mom')} AS mom FROM ranked"))
def _k1(s, d):
    return X.ranked(s, d).select("date", "ticker", "rank", rnd("mom").alias("mom"))


_PR = lambda c, part="date": f"(rank() OVER (PARTITION BY {part} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part}, {c}) - 1) / 2.0::double) / count(*) OVER (PARTITION BY {part})"


@query("rnk02_pct_rank", with_(BARS, body=f"SELECT ticker, date, {r6(_PR('volume'))} AS pct_rank FROM bars"))
def _k2(s, d):
    """Volumes tie often, so average ranks matter."""
    return pct_rank(A.bars(s, d), "volume", ("date",)).select("ticker", "date", rnd("pct_rank").alias("pct_rank"))


@query("rnk02_pct_rank_whole_table", f"""SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, (rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::double) / count(*) OVER () AS pct_rank FROM lineitem""")
def _k2b(s, d):
    """One group holding every row."""
    li = A.table(s, d, "lineitem")
    return pct_rank(li, "l_extendedprice", ()).select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), "pct_rank")


@query("rnk03_decile_signal", with_(BARS, X.PANEL_SQL, f"pr AS (SELECT date, ticker, {_PR('mom')} AS r FROM panel WHERE mom IS NOT NULL)",
    body="SELECT date, ticker, CASE WHEN r > 0.9 THEN 1 WHEN r < 0.1 THEN -1 ELSE 0 END AS decile_signal FROM pr"))
def _k3(s, d):
    p = X.panel(s, d).where(F.col("mom").isNotNull())
    return K.decile_signal(pct_rank(p, "mom")).select("date", "ticker", "decile_signal")


@query("rnk04_composite_rank", with_(BARS, X.PANEL_SQL, f"""pr AS (SELECT date, ticker, 0.5::double * {_PR('mom')} + 0.3::double * {_PR('vol60')} + 0.2::double * {_PR('avg_turnover20')} AS c
  FROM panel WHERE mom IS NOT NULL AND vol60 IS NOT NULL AND avg_turnover20 IS NOT NULL)""",
    body=f"SELECT date, ticker, {r6('c')} AS composite FROM pr QUALIFY row_number() OVER (PARTITION BY date ORDER BY c DESC, ticker) <= 15"))
def _k4(s, d):
    p = X.panel(s, d).dropna(subset=["mom", "vol60", "avg_turnover20"])
    return K.composite_rank(p, {"mom": 0.5, "vol60": 0.3, "avg_turnover20": 0.2}, 15).select("date", "ticker", rnd("composite").alias("composite"))


@query("rnk05_n_largest", with_(BARS, f"t AS (SELECT ticker, sum(volume * close) AS v FROM bars GROUP BY 1)", body=f"SELECT ticker, {r6('v', 2)} AS turnover FROM t ORDER BY v DESC, ticker LIMIT 20"))
def _k5(s, d):
    t = A.bars(s, d).groupBy("ticker").agg(F.sum(F.col("volume") * F.col("close")).alias("turnover"))
    return K.n_largest(t, "turnover", 20).select("ticker", rnd("turnover", 2).alias("turnover"))


@query("rnk06_top_long_short", with_(BARS, STATE_SQL, SIGNALS_SQL, body=f"""SELECT * FROM (SELECT ticker, {r6('position')} AS position, 'long' AS side FROM sig WHERE position > 0 ORDER BY sig.position DESC, ticker LIMIT 10)
  UNION ALL SELECT * FROM (SELECT ticker, {r6('position')} AS position, 'short' AS side FROM sig WHERE position < 0 ORDER BY sig.position, ticker LIMIT 5)"""))
def _k6(s, d):
    return K.top_long_short(raw_signals(s, d), 10, 5).select("ticker", rnd("position").alias("position"), "side")


def greedy_sql(n, cap):
    """Names taken one by one in rank order while their sector has room."""
    return f"""cand AS MATERIALIZED (SELECT date, ticker, sector, row_number() OVER (PARTITION BY date ORDER BY mom DESC, ticker) AS rn
  FROM panel JOIN sectors USING (ticker) WHERE mom IS NOT NULL),
gr AS (SELECT date, rn, CASE WHEN true THEN [ticker] END AS book, [sector] AS secs FROM cand WHERE rn = 1
  UNION ALL SELECT g.date, c.rn,
    CASE WHEN len(g.book) < {n} AND (c.sector = 'ASIA' OR len(list_filter(g.secs, lambda x: x = c.sector)) < {cap}) THEN list_append(g.book, c.ticker) ELSE g.book END,
    CASE WHEN len(g.book) < {n} AND (c.sector = 'ASIA' OR len(list_filter(g.secs, lambda x: x = c.sector)) < {cap}) THEN list_append(g.secs, c.sector) ELSE g.secs END
  FROM gr g JOIN cand c ON c.date = g.date AND c.rn = g.rn + 1)"""


@query("rnk07_sector_capped_top_n", with_(BARS, SECTORS, X.PANEL_SQL, greedy_sql(10, 2), recursive=True,
    body="SELECT date, unnest(arg_max(book, rn)) AS ticker FROM gr GROUP BY date"))
def _k7(s, d):
    p = with_sector(s, d, X.panel(s, d))
    return K.sector_capped_top_n(p, "mom", 10, 2, uncapped="ASIA").select("date", "ticker")


@query("rnk08_with_slot", with_(BARS, X.PANEL_SQL, X.RANKED_SQL, body="""SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY
  CASE WHEN cast(substring(ticker, 2, 10) AS bigint) % 2 = 0 THEN 0 ELSE 1 END, rank, ticker) AS slot FROM ranked"""))
def _k8(s, d):
    held = A.table(s, d, "supplier").where("s_suppkey % 2 = 0").select(A.ticker_of("s_suppkey").alias("ticker"))
    return K.with_slot(X.ranked(s, d), held).select("date", "ticker", "slot")


@query("rnk09_best_config", with_(BRAND_BARS, X.EQUITY_SQL, """sh AS (SELECT portfolio, year(date) AS y, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe FROM equity GROUP BY 1, 2)""",
    body=f"SELECT cast(y AS int) AS y, arg_max(portfolio, sharpe) AS portfolio, {r6('max(sharpe)')} AS sharpe FROM sh GROUP BY y"))
def _k9(s, d):
    e = X.brand_equity(s, d).groupBy("portfolio", F.year("date").alias("y")).agg((F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0))).alias("sharpe"))
    e = e.withColumn("config_id", F.regexp_replace("portfolio", "[^0-9]", "").cast("int"))
    return K.best_config(e, "sharpe", ("y",)).select("y", "portfolio", rnd("sharpe").alias("sharpe"))


@query("rnk10_latest_n", with_(PRICED, TRADES, body="SELECT trade_id, symbol, date FROM trades ORDER BY date DESC, trade_id DESC LIMIT 50"))
def _k10(s, d):
    return K.latest_n(A.trades(s, d), 50, ("date", "trade_id")).select("trade_id", "symbol", "date")
