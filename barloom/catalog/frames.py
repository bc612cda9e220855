"""Frames shared by several query families, each in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import portfolio as P
from ..operators import rank as K
from ..operators import regime as R
from ..plans.backtest import month_end_panel
from ..plans.screen import screen_indicators  # noqa: F401
from ..operators.calendar import month_end_dates
from ..sources import adapters as A
from ..sources.scratch import cut
from .base import BARS, BRAND_BARS, INDEX, key_sql, lagx, over, ret_sql, roll

def panel(s, d, bars=None):
    """Written once: book and prices read it several times. Month ends are read off the lines, or off bars that are written already."""
    dates = month_end_dates(A.priced_lines(s, d) if bars is None else bars)
    return cut(month_end_panel(A.bars(s, d) if bars is None else bars, dates), "panel")


IND_SQL = f"""ind AS MATERIALIZED (SELECT *, {lagx('close', 21)} / nullif({lagx('close', 252)}, 0) - 1 AS mom,
  {roll('stddev_samp', 'r', 60)} * sqrt(252.0::double) AS vol60, {ret_sql(5)} AS ret5,
  {roll('avg', 'close', 200)} AS sma200, {roll('avg', 'close * volume', 20)} AS avg_turnover20,
  {roll('avg', 'volume', 5)} AS avg_volume5 FROM (SELECT *, {ret_sql()} AS r FROM bars))"""

PANEL_SQL = IND_SQL + """,
me AS (SELECT date_trunc('month', date) AS month, max(date) AS date FROM bars GROUP BY 1),
panel AS MATERIALIZED (SELECT me.date, i.ticker, i.close, i.mom, i.vol60, i.ret5, i.sma200, i.avg_turnover20,
    i.avg_volume5, i.volume
  FROM (SELECT *, date_trunc('month', date) AS month FROM ind
        QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('month', date) ORDER BY date DESC) = 1) i
  JOIN me ON me.month = i.month)"""


def ranked_of(pan, n=20):
    ok = pan.where((F.col("close") > F.col("sma200")) & F.col("mom").isNotNull())
    return K.top_n(ok, "mom", n).withColumn("config_id", F.lit(1))


def ranked(s, d):
    return ranked_of(panel(s, d))


RANKED_SQL = """ranked AS MATERIALIZED (SELECT *, 1 AS config_id FROM (SELECT *,
  row_number() OVER (PARTITION BY date ORDER BY mom DESC, ticker) AS rank FROM panel
  WHERE close > sma200 AND mom IS NOT NULL) WHERE rank <= 20)"""


def _fold_sql(name: str, depth: int, step: str) -> str:
    """Selection recursion over dates; `step` maps (held, names) to the next book."""
    return f"""{name}_days AS MATERIALIZED (SELECT date, list(ticker ORDER BY rank) AS names,
    row_number() OVER (ORDER BY date) AS i FROM ranked WHERE rank <= {depth} GROUP BY date),
{name}_walk AS (
  SELECT i, date, {step.replace('HELD', "cast([] AS varchar[])").replace('NAMES', 'names')} AS book FROM {name}_days WHERE i = 1
  UNION ALL
  SELECT n.i, n.date, {step.replace('HELD', 'w.book').replace('NAMES', 'n.names')} FROM {name}_walk w JOIN {name}_days n ON n.i = w.i + 1),
{name} AS MATERIALIZED (SELECT 1 AS config_id, date, unnest(book) AS ticker, unnest(range(1, len(book) + 1)) AS slot FROM {name}_walk)"""


_KEPT = "list_filter(NAMES[1:15], lambda x: list_contains(HELD, x))"
HOLD_STEP = f"""list_concat({_KEPT},
    list_filter(NAMES, lambda x: NOT list_contains({_KEPT}, x))[1:greatest(0, 5 - len({_KEPT}))])"""
HOLD_SQL = _fold_sql("hold", 20, HOLD_STEP)
HOLD_V1_SQL = _fold_sql("holdv", 15, f"""CASE WHEN len(NAMES) < 5 THEN NAMES ELSE list_concat({_KEPT},
    list_filter(NAMES[1:5], lambda x: NOT list_contains({_KEPT}, x)))[1:5] END""")


def book(s, d, pan=None):
    """Monthly momentum book with capped momentum weights: config_id, date, ticker, weight."""
    pan = pan or panel(s, d)
    sel = P.hold_buffer(ranked_of(pan), 5, 15, dates=pan).join(pan.select("date", "ticker", "mom", "close"), ["date", "ticker"])
    return P.cap_weights(P.momentum_weights(sel, keys=("config_id", "date")), 0.30, 5, ("config_id", "date"))


def book_and_panel(s, d, bars=None):
    """The book, the panel that it is chosen from, and the rebalance dates."""
    pan = panel(s, d, bars)
    return cut(book(s, d, pan), "book"), pan, month_end_dates(pan)


def cap_sql(src: str, out: str, cap: float = 0.30, rounds: int = 5, key: str = "config_id, date") -> str:
    """Unrolled clipping rounds from src(weight) to out(weight)."""
    parts, prev = [], f"(SELECT *, false AS capped FROM {src})"
    for i in range(rounds):
        w = f"(PARTITION BY {key})"
        hit = f"(weight > {cap} AND NOT capped)"
        parts.append(f"""{out}_{i} AS (SELECT * REPLACE (CASE WHEN {hit} THEN {cap}::double WHEN capped OR over_ = 0 THEN weight
      WHEN room > 0 THEN weight + over_ * (weight / room) ELSE weight + over_ / nullif(free, 0) END AS weight, capped OR {hit} AS capped)
    FROM (SELECT * EXCLUDE ({'over_, room, free' if i else 'capped'}), {'' if i else 'capped, '}
      sum(CASE WHEN {hit} THEN weight - {cap} ELSE 0 END) OVER {w} AS over_,
      sum(CASE WHEN NOT {hit} AND NOT capped THEN weight ELSE 0 END) OVER {w} AS room,
      sum(CASE WHEN NOT {hit} AND NOT capped THEN 1 ELSE 0 END) OVER {w} AS free FROM {prev}))""")
        prev = f"{out}_{i}"
    parts.append(f"{out} AS MATERIALIZED (SELECT * FROM {prev})")
    return ",\n".join(parts)


_MW = """CASE WHEN sum(greatest(coalesce(mom, 0), 0)) OVER k > 0 THEN greatest(coalesce(mom, 0), 0) / sum(greatest(coalesce(mom, 0), 0)) OVER k
    ELSE 1.0 / count(*) OVER k END"""
BOOK_SQL = HOLD_SQL + f""",
held AS (SELECT h.config_id, h.date, h.ticker, h.slot, p.mom, p.close FROM hold h JOIN panel p ON p.date = h.date AND p.ticker = h.ticker),
mw AS (SELECT *, {_MW} AS weight FROM held WINDOW k AS (PARTITION BY config_id, date)),
""" + cap_sql("mw", "book")

BOOK = (BARS, PANEL_SQL, RANKED_SQL, BOOK_SQL)


def brand_equity(s, d):
    """Brands as portfolios: portfolio, date, capital, ret."""
    b = I.ret_n(A.brand_bars(s, d), 1)
    return b.select(F.col("ticker").alias("portfolio"), "date", F.col("close").alias("capital"), F.col("ret1").alias("ret"))


def market_returns(s, d):
    idx = R.synthetic_index(A.brand_bars(s, d))
    return idx.select("date", (I.div("close", I.lag("close", 1, "index_id")) - 1).alias("mkt_ret"))


EQUITY_SQL = f"""equity AS MATERIALIZED (SELECT ticker AS portfolio, date, close AS capital, {ret_sql()} AS ret FROM bars)"""
MARKET_SQL = INDEX + """,
market AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS mkt_ret FROM idx)"""
JOINED_SQL = """joined AS MATERIALIZED (SELECT portfolio, e.date, capital, ret, mkt_ret FROM equity e JOIN market m ON e.date = m.date
  WHERE ret IS NOT NULL AND mkt_ret IS NOT NULL)"""
JOINED = (BRAND_BARS, EQUITY_SQL, MARKET_SQL, JOINED_SQL)


def joined(s, d):
    from ..operators.joins import join_market
    return join_market(brand_equity(s, d), market_returns(s, d))
