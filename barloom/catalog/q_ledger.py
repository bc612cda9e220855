"""Ledger queries."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import ledger as L
from ..operators import regime as R
from ..schemas import BreakerLimits
from ..sources import adapters as A
from ..sources import tables as S
from . import frames as X
from .base import BARS, BRAND_BARS, INDEX, ORDER_FLOW, PRICED, TRADES, query, r6, roll, run, with_
from .q_portfolio import r

INIT = 1e10
T = (PRICED, TRADES)
_SQ = "CASE WHEN side = 'buy' THEN qty ELSE -qty END"
_RS = "(PARTITION BY strategy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
CASH = f"""fl AS (SELECT strategy, date, sum(-({_SQ}) * price) AS f FROM trades GROUP BY 1, 2),
ca AS MATERIALIZED (SELECT strategy, date, 10000000000.0::double + sum(f) OVER {_RS} AS cash FROM fl)"""


@query("led01_replay_cash", with_(*T, CASH, f"""gd AS (SELECT s.strategy, d.date FROM (SELECT DISTINCT strategy FROM trades) s, (SELECT DISTINCT cast(o_orderdate AS date) AS date FROM orders) d)""",
    body=f"SELECT gd.strategy, gd.date, {r6('coalesce(cash, 10000000000) / 1000000', 4)} AS cash_m FROM gd ASOF LEFT JOIN ca ON ca.strategy = gd.strategy AND gd.date >= ca.date"))
def _1(s, d):
    days = A.table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    c = L.replay_cash(A.trades(s, d), INIT, days)
    return c.select("strategy", "date", rnd(F.col("cash") / 1e6, 4).alias("cash_m"))


@query("led01_replay_quantities", with_(*T, f"""nt AS (SELECT strategy, symbol, date, sum({_SQ}) AS n FROM trades GROUP BY 1, 2, 3),
q AS (SELECT strategy, symbol, date, lead(date) OVER (PARTITION BY strategy, symbol ORDER BY date) AS next_date, sum(n) OVER (PARTITION BY strategy, symbol ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qty FROM nt)""", body="SELECT * FROM q WHERE qty > 0.00001"))
def _1b(s, d):
    return L.replay_quantities(A.trades(s, d))


AVG = f"""tq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY strategy, symbol ORDER BY date, sec, trade_id) AS i FROM trades),
wk AS (SELECT strategy, symbol, trade_id, i, side, qty AS q, price AS avg, CAST(NULL AS double) AS realised FROM tq WHERE i = 1
  UNION ALL SELECT n.strategy, n.symbol, n.trade_id, n.i, n.side,
    CASE WHEN n.side = 'buy' THEN w.q + n.qty WHEN w.q - n.qty < 0.000001 THEN 0 ELSE w.q - n.qty END,
    CASE WHEN n.side = 'buy' THEN (w.q * w.avg + n.qty * n.price) / (w.q + n.qty) ELSE w.avg END,
    CASE WHEN n.side = 'sell' THEN (n.price - w.avg) * n.qty END
  FROM wk w JOIN tq n ON n.strategy = w.strategy AND n.symbol = w.symbol AND n.i = w.i + 1)"""


@query("led02_average_cost", with_(*T, AVG, recursive=True, body=f"SELECT strategy, symbol, trade_id, q AS qty_after, {r6('CASE WHEN q >= 0.000001 THEN avg END', 5)} AS avg_cost FROM wk"))
def _2(s, d):
    return r(L.average_cost(A.trades(s, d)), "avg_cost", places=5).select("strategy", "symbol", "trade_id", "qty_after", "avg_cost")


@query("led02_open_positions", with_(*T, AVG, recursive=True, body=f"""SELECT strategy, symbol, arg_max(q, i) AS qty, {r6('arg_max(avg, i)', 5)} AS avg_cost FROM wk GROUP BY 1, 2 HAVING arg_max(q, i) >= 0.000001"""))
def _2b(s, d):
    return r(L.open_positions(A.trades(s, d)), "avg_cost", places=5)


@query("led03_realised_pnl", with_(*T, AVG, recursive=True, body=f"SELECT strategy, symbol, trade_id, {r6('realised', 3)} AS realised FROM wk WHERE side = 'sell'"))
def _3(s, d):
    return r(L.realised_pnl(A.trades(s, d)), "realised", places=3).select("strategy", "symbol", "trade_id", "realised")


MARK = """ps AS (SELECT strategy, symbol, arg_max(q, i) AS qty, arg_max(avg, i) AS avg_cost FROM wk GROUP BY 1, 2 HAVING arg_max(q, i) >= 0.000001),
px AS (SELECT symbol, arg_max(price, row(date, sec, trade_id)) AS price FROM trades GROUP BY 1),
mk AS MATERIALIZED (SELECT ps.*, price, qty * price AS mv, (price - avg_cost) * qty AS un FROM ps JOIN px USING (symbol))"""


def marked(s, d):
    t = A.trades(s, d)
    return L.mark_to_market(L.open_positions(t), L.last_prices(t))


@query("led04_mark_to_market", with_(*T, AVG, MARK, recursive=True, body=f"SELECT strategy, symbol, {r6('mv', 2)} AS market_value, {r6('un', 2)} AS unrealised, {r6('(price / avg_cost - 1) * 100')} AS unrealised_pct FROM mk"))
def _4(s, d):
    m = r(r(marked(s, d), "market_value", "unrealised", places=2), "unrealised_pct")
    return m.select("strategy", "symbol", "market_value", "unrealised", "unrealised_pct")


@query("led05_portfolio_totals", with_(*T, CASH, AVG, MARK, recursive=True, body=f"""SELECT strategy, count(*) AS names, {r6('sum(mv) / 1000000', 4)} AS holdings_m,
  {r6('((any_value(c.cash) + sum(mv)) / 10000000000.0::double - 1) * 100')} AS total_return FROM mk JOIN (SELECT strategy, arg_max(cash, date) AS cash FROM ca GROUP BY 1) c USING (strategy) GROUP BY 1"""))
def _5(s, d):
    cash = L.replay_cash(A.trades(s, d), INIT).groupBy("strategy").agg(F.max_by("cash", "date").alias("cash"))
    t = L.portfolio_totals(marked(s, d), cash, INIT)
    return t.select("strategy", "names", rnd(F.col("holdings") / 1e6, 4).alias("holdings_m"), rnd("total_return").alias("total_return"))


VALUES = f"""dd AS (SELECT DISTINCT s.strategy, b.date FROM (SELECT DISTINCT strategy, symbol FROM trades) s JOIN bars b ON b.ticker = s.symbol
  UNION SELECT strategy, date FROM trades),
hs AS (SELECT strategy, symbol, date, sum(n) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qty FROM (
  SELECT strategy, symbol, date, sum({_SQ}) AS n FROM trades GROUP BY 1, 2, 3)),
full_ AS (SELECT dd.strategy, dd.date, o.symbol FROM dd JOIN (SELECT DISTINCT strategy, symbol FROM trades) o ON o.strategy = dd.strategy),
fq AS (SELECT f.*, coalesce(h.qty, 0) AS qty FROM full_ f ASOF LEFT JOIN hs h ON h.strategy = f.strategy AND h.symbol = f.symbol AND f.date >= h.date),
fp AS (SELECT f.*, coalesce(b.close, 0) AS px FROM fq f ASOF LEFT JOIN bars b ON b.ticker = f.symbol AND f.date >= b.date),
hv AS (SELECT strategy, date, sum(CASE WHEN qty > 0.00001 THEN qty * px ELSE 0 END) AS hv FROM fp GROUP BY 1, 2),
pv AS MATERIALIZED (SELECT hv.strategy, hv.date, hv + coalesce(cash, 10000000000) AS v FROM hv ASOF LEFT JOIN ca ON ca.strategy = hv.strategy AND hv.date >= ca.date)"""


@query("led06_daily_snapshots", with_(BARS, TRADES, CASH, VALUES, body=f"""SELECT strategy, date, {r6('v / 1000000', 3)} AS value_m,
  {r6('(v - coalesce(lag(v) OVER (PARTITION BY strategy ORDER BY date), 10000000000)) / 1000000', 3)} AS pnl_m FROM pv"""))
def _6(s, d):
    v = L.daily_snapshots(L.portfolio_values(A.trades(s, d), A.bars(s, d), INIT), INIT)
    return v.select("strategy", "date", rnd(F.col("portfolio_value") / 1e6, 3).alias("value_m"), rnd(F.col("daily_pnl") / 1e6, 3).alias("pnl_m"))


@query("led07_complete_prices_only", with_(*T, AVG, MARK, recursive=True, body="""SELECT strategy, symbol FROM mk WHERE strategy NOT IN (SELECT strategy FROM mk WHERE symbol = 'S0000000003')"""))
def _7(s, d):
    m = marked(s, d).withColumn("price", F.when(F.col("symbol") != "S0000000003", F.col("price")))
    return L.complete_prices_only(m).select("strategy", "symbol")


@query("led08_upsert", with_(BARS, body=f"""SELECT ticker, date, {r6("CASE WHEN date >= date '2000-01-01' THEN close * 3 ELSE close END")} AS close FROM bars"""))
def _8(s, d):
    b = A.bars(s, d).select("ticker", "date", "close")
    new = b.where("date >= date'2000-01-01'").withColumn("close", F.col("close") * 3)
    return S.upsert(b, new, ["ticker", "date"]).withColumn("close", rnd("close"))


@query("led09_rebase_benchmark", with_(BRAND_BARS, INDEX, body=f"""SELECT date, {r6("close / (SELECT arg_max(close, date) FROM idx WHERE date < date '1997-06-01') * 1000000", 3)} AS bench_value
  FROM idx WHERE date >= date '1997-06-01'"""))
def _9(s, d):
    return L.rebase_benchmark(R.synthetic_index(A.brand_bars(s, d)), "1997-06-01", 1e6).select("date", rnd("bench_value", 3).alias("bench_value"))


GRID = """gr AS MATERIALIZED (SELECT portfolio, e.date, capital * 1000 AS pv, i.close * 1000 AS bv FROM equity e JOIN idx i ON i.date = e.date)"""


def grid(s, d):
    idx = R.synthetic_index(A.brand_bars(s, d)).select("date", (F.col("close") * 1000).alias("bench_value"))
    return X.brand_equity(s, d).select("portfolio", "date", (F.col("capital") * 1000).alias("portfolio_value")).join(idx, "date")


_P = "(PARTITION BY portfolio ORDER BY date)"
_PR = run("portfolio")


@query("led10_benchmark_metrics", with_(BRAND_BARS, X.EQUITY_SQL, INDEX, GRID, f"""g2 AS (SELECT *, coalesce(pv / lag(pv) OVER {_P} - 1, 0) AS pr, coalesce(bv / lag(bv) OVER {_P} - 1, 0) AS br,
  pv / greatest(max(pv) OVER {_PR}, 1000000) - 1 AS pdd, bv / greatest(max(bv) OVER {_PR}, 1000000) - 1 AS bdd FROM gr)""", body=f"""SELECT portfolio,
  {r6('(arg_max(pv, date) / 1000000 - 1) * 100')} AS portfolio_return, {r6('(arg_max(bv, date) / 1000000 - 1) * 100')} AS bench_return,
  {r6('(arg_max(pv, date) / 1000000 - 1) * 100 - (arg_max(bv, date) / 1000000 - 1) * 100')} AS alpha, {r6('covar_samp(pr, br) / var_samp(br)')} AS beta,
  {r6('(avg(pr) - 0.065::double / 252) * sqrt(252.0::double) / stddev_samp(pr)')} AS sharpe, {r6('min(pdd) * 100')} AS portfolio_mdd, {r6('min(bdd) * 100')} AS bench_mdd FROM g2 GROUP BY 1"""))
def _10(s, d):
    m = L.benchmark_metrics(grid(s, d), 1e6)
    return r(m, *[c for c in m.columns if c != "portfolio"])


@query("led11_monthly_vs_benchmark", with_(BRAND_BARS, X.EQUITY_SQL, INDEX, GRID, """mo AS (SELECT portfolio, cast(date_trunc('month', date) AS date) AS month, arg_max(pv, date) AS pv, arg_max(bv, date) AS bv FROM gr GROUP BY 1, 2),
m2 AS (SELECT portfolio, month, (pv / coalesce(lag(pv) OVER w, 1000000) - 1) * 100 AS a, (bv / coalesce(lag(bv) OVER w, 1000000) - 1) * 100 AS b FROM mo WINDOW w AS (PARTITION BY portfolio ORDER BY month))""",
    body=f"SELECT portfolio, month, {r6('a')} AS portfolio_return, {r6('b')} AS bench_return, {r6('a - b')} AS alpha FROM m2"))
def _11(s, d):
    return r(L.monthly_vs_benchmark(grid(s, d), 1e6), "portfolio_return", "bench_return", "alpha")


VALID = """oq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY account ORDER BY date, sec, order_id) AS i FROM flow),
ov AS (
  SELECT account, order_id, i, cash - CASE WHEN st = 'ok' THEN CASE WHEN side = 'buy' THEN cost ELSE -cost END ELSE 0 END AS cash, st,
    p0 + CASE WHEN st = 'ok' AND symbol = 'P0' THEN dq ELSE 0 END AS p0, p1 + CASE WHEN st = 'ok' AND symbol = 'P1' THEN dq ELSE 0 END AS p1, p2 + CASE WHEN st = 'ok' AND symbol = 'P2' THEN dq ELSE 0 END AS p2
  FROM (SELECT *, CASE WHEN side = 'buy' THEN qty ELSE -qty END AS dq, qty * price AS cost, 200000.0::double AS cash, 0.0::double AS p0, 0.0::double AS p1, 0.0::double AS p2,
    CASE WHEN qty <= 0 THEN 'bad_qty' WHEN side = 'buy' THEN CASE WHEN 200000 >= qty * price THEN 'ok' ELSE 'no_cash' END ELSE 'no_shares' END AS st FROM oq WHERE i = 1)
  UNION ALL
  SELECT account, order_id, i, cash - CASE WHEN st = 'ok' THEN CASE WHEN side = 'buy' THEN cost ELSE -cost END ELSE 0 END, st,
    p0 + CASE WHEN st = 'ok' AND symbol = 'P0' THEN dq ELSE 0 END, p1 + CASE WHEN st = 'ok' AND symbol = 'P1' THEN dq ELSE 0 END, p2 + CASE WHEN st = 'ok' AND symbol = 'P2' THEN dq ELSE 0 END
  FROM (SELECT n.account, n.order_id, n.i, n.side, n.symbol, CASE WHEN n.side = 'buy' THEN n.qty ELSE -n.qty END AS dq, n.qty * n.price AS cost, w.cash, w.p0, w.p1, w.p2,
    CASE WHEN n.qty <= 0 THEN 'bad_qty' WHEN n.side = 'buy' THEN CASE WHEN w.cash >= n.qty * n.price THEN 'ok' ELSE 'no_cash' END
      WHEN CASE n.symbol WHEN 'P0' THEN w.p0 WHEN 'P1' THEN w.p1 ELSE w.p2 END >= n.qty THEN 'ok' ELSE 'no_shares' END AS st
    FROM ov w JOIN oq n ON n.account = w.account AND n.i = w.i + 1))"""


@query("led12_validate_orders", with_(PRICED, ORDER_FLOW, VALID, recursive=True, body=f"SELECT account, order_id, st AS status, {r6('cash', 3)} AS cash_after FROM ov"))
def _12(s, d):
    return r(L.validate_orders(A.order_flow(s, d), 200000.0), "cash_after", places=3).select("account", "order_id", "status", "cash_after")


BREAK = """be AS MATERIALIZED (SELECT portfolio, date, capital, row_number() OVER (PARTITION BY portfolio ORDER BY date) AS i FROM equity),
bw AS (SELECT portfolio, date, i, capital AS hwm, false AS kill, CAST(NULL AS date) AS trip, date AS md, capital AS mc, 'OK' AS status FROM be WHERE i = 1
  UNION ALL SELECT portfolio, date, i, h, k, CASE WHEN k OR cool THEN trip WHEN loss THEN date END, CASE WHEN NOT k AND NOT cool AND NOT loss AND due THEN date ELSE md END,
    CASE WHEN NOT k AND NOT cool AND NOT loss AND due THEN capital ELSE mc END, CASE WHEN k THEN 'KILL_SWITCH' WHEN cool THEN 'BREAKER_ACTIVE' WHEN loss THEN 'BREAKER_TRIPPED' ELSE 'OK' END
  FROM (SELECT n.portfolio, n.date, n.i, n.capital, greatest(w.hwm, n.capital) AS h, w.kill OR n.capital / greatest(w.hwm, n.capital) - 1 <= -0.28 AS k, w.trip, w.md, w.mc,
    w.trip IS NOT NULL AND n.date - w.trip < 25 AS cool, n.date - w.md >= 20 AS due, n.date - w.md >= 20 AND n.capital / w.mc - 1 < -0.08 AS loss
    FROM bw w JOIN be n ON n.portfolio = w.portfolio AND n.i = w.i + 1))"""


@query("led13_breaker_state", with_(BRAND_BARS, X.EQUITY_SQL, BREAK, recursive=True, body="SELECT portfolio, date, status FROM bw"))
def _13(s, d):
    return L.breaker_state(X.brand_equity(s, d), BreakerLimits(kill_drawdown=-0.28))


@query("led14_per_strategy", with_(*T, AVG, recursive=True, body=f"SELECT strategy, {r6('sum(realised)', 1)} AS realised FROM wk WHERE strategy IN ('A') GROUP BY 1"))
def _14(s, d):
    t = L.realised_pnl(L.per_strategy(A.trades(s, d), ("A",)))
    return t.groupBy("strategy").agg(rnd(F.sum("realised"), 1).alias("realised"))


@query("led15_price_cache", "SELECT 'U' || cast(user_id AS varchar) AS symbol, arg_max(value, ts) AS price, max(ts) AS updated_at FROM events GROUP BY 1")
def _15(s, d):
    return L.price_cache(A.ticks(s, d))
