"""Join and set queries."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import attribution as AT
from ..operators import calendar as CAL
from ..operators import clean as C
from ..operators import indicators as I
from ..operators import joins as J
from ..operators import regime as R
from ..sources import adapters as A
from . import frames as X
from .base import BARS, BRAND_BARS, INDEX, SECTORS, over, query, r6, ret_sql, roll, run, with_
from .q_clean import before, month_grid, since
from .q_derivatives_sql import OPTIONS

LABEL_SQL = """cal AS (SELECT DISTINCT date FROM bars),
ntd AS (SELECT date, coalesce(lead(date) OVER (ORDER BY date), date) AS exec_date FROM cal),
rb AS (SELECT max(date) AS date FROM bars GROUP BY date_trunc('month', date)),
hp AS (SELECT * FROM (SELECT rb.date, exec_date, lead(rb.date) OVER (ORDER BY rb.date) AS next_date,
  lead(exec_date) OVER (ORDER BY rb.date) AS next_exec FROM rb JOIN ntd ON ntd.date = rb.date) WHERE next_date IS NOT NULL),
labels_ AS MATERIALIZED (SELECT hp.date, a.ticker, b.open / a.open - 1 AS label FROM hp JOIN bars a ON a.date = hp.exec_date
  JOIN bars b ON b.ticker = a.ticker AND b.date = hp.next_exec)"""


def labels(s, d, brands=True):
    b = A.brand_bars(s, d) if brands else A.bars(s, d)
    return AT.open_to_open_label(b, CAL.month_end_dates(b), CAL.calendar(b))


@query("jn01_join_labels", with_(BRAND_BARS, LABEL_SQL, f"f AS (SELECT ticker, date, {ret_sql(21)} AS ret21 FROM bars)",
    body=f"SELECT f.ticker, f.date, {r6('ret21')} AS ret21, {r6('label')} AS label FROM f JOIN labels_ l ON l.ticker = f.ticker AND l.date = f.date"))
def _j1(s, d):
    f = I.ret_n(A.brand_bars(s, d), 21).select("ticker", "date", "ret21")
    return J.join_labels(f, labels(s, d)).select("ticker", "date", rnd("ret21").alias("ret21"), rnd("label").alias("label"))


@query("jn02_join_market", with_(*X.JOINED, body=f"SELECT portfolio, date, {r6('ret')} AS ret, {r6('mkt_ret')} AS mkt_ret FROM joined"))
def _j2(s, d):
    return X.joined(s, d).select("portfolio", "date", rnd("ret").alias("ret"), rnd("mkt_ret").alias("mkt_ret"))


@query("jn03_attach_by_date", with_(BARS, INDEX, f"ix AS (SELECT date, {roll('avg', 'close', 100, 1, 'index_id')} AS index_sma FROM idx)",
    body=f"SELECT b.ticker, b.date, {r6('index_sma')} AS index_sma FROM bars b LEFT JOIN ix ON ix.date = b.date"))
def _j3(s, d):
    b = A.bars(s, d)
    ix = R.synthetic_index(b).select("date", I.rolling(F.avg, "close", 100, 1, "index_id").alias("index_sma"))
    return J.attach_by_date(b, ix).select("ticker", "date", rnd("index_sma").alias("index_sma"))


@query("jn04_lookup", with_(BARS, SECTORS, body="""SELECT b.ticker, date, coalesce(CASE WHEN sector <> 'AFRICA' THEN sector END, 'General') AS sector
  FROM bars b LEFT JOIN sectors s ON s.ticker = b.ticker"""))
def _j4(s, d):
    dim = A.sector_map(s, d).where("sector <> 'AFRICA'")
    return J.lookup(A.bars(s, d), dim, "ticker", "sector", "General").select("ticker", "date", "sector")


@query("jn05_asof_join", with_(BARS, """q AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p,
  'S' || lpad(cast((l_suppkey * 7 + 1) % (SELECT count(*) FROM supplier) AS varchar), 10, '0') AS ticker, cast(l_shipdate AS date) AS date FROM lineitem)""",
    body=f"""SELECT k, n, p, q.ticker, q.date, {r6('coalesce(b.close, 0)')} AS close FROM q ASOF LEFT JOIN bars b
  ON b.ticker = q.ticker AND q.date >= b.date"""))
def _j5(s, d):
    """Every line asks for another supplier's last close: many questions per ticker and day."""
    n = A.table(s, d, "supplier").agg(F.count(F.lit(1))).scalar()
    li = A.table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"),
        F.concat(F.lit("S"), F.lpad(((F.col("l_suppkey") * 7 + 1) % n).cast("string"), 10, "0")).alias("ticker"),
        F.to_date("l_shipdate").alias("date"))
    b = A.bars(s, d).select("ticker", "date", "close")
    return J.asof_join(li, b, ["ticker"], "date", {"close": 0.0}).select(
        "k", "n", "p", "ticker", "date", rnd("close").alias("close"))


@query("jn06_range_join", with_(BARS, """ev AS (SELECT ticker AS symbol, max(date) AS entry, max(date) + 45 AS expiry FROM bars
  GROUP BY ticker, date_trunc('month', date))""", body=f"""SELECT symbol, entry, expiry, b.date, {r6('b.close')} AS close
  FROM ev JOIN bars b ON b.ticker = symbol AND b.date > entry AND b.date <= expiry"""))
def _j6(s, d):
    b = A.bars(s, d).withColumnRenamed("ticker", "symbol")
    ev = b.groupBy("symbol", F.trunc("date", "month").alias("m")).agg(F.max("date").alias("entry")).select(
        "symbol", "entry", F.date_add("entry", 45).alias("expiry"))
    return J.range_join(ev, b, "entry", "expiry").select("symbol", "entry", "expiry", "date", rnd("close").alias("close"))


@query("jn07_two_legs", with_(BARS, OPTIONS, """legs AS (SELECT symbol, date, option_type, expiry_dt, min(strike) AS lo, max(strike) AS hi FROM chain GROUP BY 1, 2, 3, 4)""",
    body=f"""SELECT l.symbol, l.date, l.option_type, l.expiry_dt, {r6('a.close')} AS atm_close, {r6('b.close')} AS otm_close
  FROM legs l JOIN chain a ON a.symbol = l.symbol AND a.date = l.date AND a.option_type = l.option_type AND a.expiry_dt = l.expiry_dt AND a.strike = lo
  JOIN chain b ON b.symbol = l.symbol AND b.date = l.date AND b.option_type = l.option_type AND b.expiry_dt = l.expiry_dt AND b.strike = hi"""))
def _j7(s, d):
    chain = A.options(s, d)
    legs = chain.groupBy("symbol", "date", "option_type", "expiry_dt").agg(
        F.min("strike").alias("atm_strike"), F.max("strike").alias("otm_strike"))
    return J.two_legs(legs, chain).select("symbol", "date", "option_type", "expiry_dt",
                                          rnd("atm_close").alias("atm_close"), rnd("otm_close").alias("otm_close"))


PAIRS_SQL = """prs AS (SELECT a AS pair_id, 'Brand#' || a AS leg1, 'Brand#' || (a + 1) AS leg2 FROM (
  SELECT DISTINCT cast(regexp_replace(p_brand, '[^0-9]', '', 'g') AS int) AS a FROM part) WHERE a % 2 = 1
  AND 'Brand#' || (a + 1) IN (SELECT p_brand FROM part)),
fl AS MATERIALIZED (SELECT b.ticker, c.date, b.close FROM (SELECT ticker, date, close, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS nx FROM bars) b
  JOIN (SELECT DISTINCT date FROM bars) c ON c.date >= b.date AND c.date < coalesce(nx, DATE '9999-12-31')),
plb AS (SELECT ticker, date, close FROM fl QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 252),
ps AS MATERIALIZED (SELECT * FROM (SELECT pair_id, leg1, leg2, x.date, x.close AS p1, y.close AS p2, count(*) OVER (PARTITION BY pair_id) AS cnt_ FROM (
  SELECT * FROM prs) JOIN plb x ON x.ticker = leg1 JOIN plb y ON y.ticker = leg2 AND y.date = x.date) WHERE cnt_ >= 200)"""


def filled_bars(s, d):
    """Brand bars on every trading day: prices and volumes stand until the next trade, as the rule of pairs has them."""
    return C.fill_forward(A.brand_bars(s, d))


@query("jn08_pair_series", with_(BRAND_BARS, PAIRS_SQL, body=f"SELECT pair_id, leg1, leg2, date, {r6('p1')} AS p1, {r6('p2')} AS p2 FROM ps"))
def _j8(s, d):
    return J.pair_series(filled_bars(s, d), A.brand_pairs(s, d)).withColumn("p1", rnd("p1")).withColumn("p2", rnd("p2"))


@query("jn09_semi_anti", with_(BARS, SECTORS, body="""SELECT ticker, date, 'in' AS part FROM bars WHERE ticker IN (SELECT ticker FROM sectors WHERE sector = 'ASIA')
  UNION ALL SELECT ticker, date, 'out' FROM bars WHERE ticker NOT IN (SELECT ticker FROM sectors WHERE sector = 'ASIA')"""))
def _j9(s, d):
    b = A.bars(s, d).select("ticker", "date")
    k = A.sector_map(s, d).where("sector = 'ASIA'").select("ticker")
    return J.semi(b, k).withColumn("part", F.lit("in")).unionByName(J.anti(b, k).withColumn("part", F.lit("out")))


_TWO = """wa AS (SELECT ticker, sum(volume) / 1000.0::double AS weight FROM bars WHERE date < date '1998-01-01' AND close > 950 GROUP BY ticker),
wb AS (SELECT ticker, sum(volume) / 1000.0::double AS weight FROM bars WHERE date >= date '2001-10-01' AND close > 950 GROUP BY ticker)"""


def _two(s, d):
    w = lambda df: df.where("close > 950").groupBy("ticker").agg((F.sum("volume") / 1000.0).alias("weight"))
    b = A.bars(s, d)
    return w(before(b, "1998-01-01")), w(since(b, "2001-10-01"))


@query("jn10_outer_weights", with_(BARS, _TWO, body=f"""SELECT coalesce(wa.ticker, wb.ticker) AS ticker, {r6('coalesce(wa.weight, 0)')} AS old_weight,
  {r6('coalesce(wb.weight, 0)')} AS new_weight FROM wa FULL JOIN wb ON wa.ticker = wb.ticker"""))
def _j10(s, d):
    return J.outer_weights(*_two(s, d)).select("ticker", rnd("old_weight").alias("old_weight"), rnd("new_weight").alias("new_weight"))


@query("jn11_on_grid", with_(BARS, """g AS (SELECT t.ticker, c.date FROM (SELECT DISTINCT ticker FROM bars) t,
  (SELECT max(date) AS date FROM bars GROUP BY date_trunc('month', date)) c)""",
    body=f"SELECT g.ticker, g.date, {r6('close')} AS close FROM g LEFT JOIN bars b ON b.ticker = g.ticker AND b.date = g.date"))
def _j11(s, d):
    grid = month_grid(s, d).select("ticker", "date")
    return J.on_grid(A.bars(s, d).select("ticker", "date", "close"), grid).withColumn("close", rnd("close"))


@query("jn12_cross_configs", with_(BARS, X.PANEL_SQL, body="""SELECT config_id, date, count(*) AS n FROM panel,
  (VALUES (1, 0.0), (2, 0.1), (3, 0.2)) g(config_id, floor_) WHERE mom > floor_ GROUP BY 1, 2"""))
def _j12(s, d):
    grid = [{"config_id": i, "floor_": f} for i, f in ((1, 0.0), (2, 0.1), (3, 0.2))]
    return J.cross_configs(X.panel(s, d), grid).where("mom > floor_").groupBy("config_id", "date").agg(F.count(F.lit(1)).alias("n"))


@query("jn13_nearest_expiry_leg", with_(BARS, OPTIONS, body=f"""SELECT symbol, date, strike, option_type, min(expiry_dt) AS expiry_dt,
  {r6('arg_min(close, expiry_dt)')} AS close FROM chain GROUP BY 1, 2, 3, 4"""))
def _j13(s, d):
    return J.nearest_expiry_leg(A.options(s, d)).select("symbol", "date", "strike", "option_type", "expiry_dt", rnd("close").alias("close"))


@query("set01_trade_sets", with_(BARS, _TWO, body="""SELECT coalesce(wa.ticker, wb.ticker) AS ticker,
  CASE WHEN wb.ticker IS NULL THEN 'sell' WHEN wa.ticker IS NULL THEN 'buy' ELSE 'hold' END AS action FROM wa FULL JOIN wb ON wa.ticker = wb.ticker"""))
def _s1(s, d):
    return J.trade_sets(*_two(s, d))


@query("set02_union_dedup", with_(BARS, body=f"""SELECT ticker, date, {r6("CASE WHEN date >= date '1999-06-01' THEN close * 2 ELSE close END")} AS close
  FROM bars WHERE date < date '2000-01-01' OR date >= date '1999-06-01'"""))
def _s2(s, d):
    b = A.bars(s, d).select("ticker", "date", "close")
    out = J.union_dedup([before(b, "2000-01-01"), since(b, "1999-06-01").withColumn("close", F.col("close") * 2)], ["ticker", "date"])
    return out.withColumn("close", rnd("close"))


@query("set03_distinct", with_(BARS, body="SELECT 'tickers' AS what, count(DISTINCT ticker) AS n FROM bars UNION ALL SELECT 'dates', count(DISTINCT date) FROM bars"))
def _s3(s, d):
    b = A.bars(s, d)
    n = lambda c, w: J.distinct_of(b, c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "n")
    return n("ticker", "tickers").unionByName(n("date", "dates"))
