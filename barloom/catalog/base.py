"""Registry and the SQL text shared by the oracles.

The SQL here is written against the raw tables and independently of the Spark
code: bars come from row_number windows there and from partial aggregates here,
ranks from plain windows, recursions from recursive CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def key_sql(prefix: str, col: str) -> str:
    return f"'{prefix}' || lpad(cast({col} as varchar), 10, '0')"


_ORDER = "l_orderkey, l_linenumber, px"

PRICED = """priced AS MATERIALIZED (
  SELECT l.*, cast(l_shipdate AS date) AS date, p_brand,
         p_retailprice * (1 + l_discount - l_tax)
           * (1 + ((l_suppkey * 7919) % 21 - 10)
                * (cast(l_shipdate AS date) - date '1995-01-01') / 100000.0::double)
           / 1.000003::double AS px
  FROM lineitem l JOIN part ON l_partkey = p_partkey)"""


def _bars(name: str, key: str, label: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT {label} AS ticker, date, max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high,
         min(px) AS low, max(CASE WHEN rn = n THEN px END) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, row_number() OVER (PARTITION BY {key}, date ORDER BY {_ORDER}) AS rn,
               count(*) OVER (PARTITION BY {key}, date) AS n FROM priced)
  GROUP BY {key}, date)"""


BARS = PRICED + ",\n" + _bars("bars", "l_suppkey", key_sql("S", "l_suppkey"))
BRAND_BARS = PRICED + ",\n" + _bars("bars", "p_brand", "p_brand")

SECTORS = f"""sectors AS (
  SELECT {key_sql("S", "s_suppkey")} AS ticker, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

BRAND_SECTORS = """sectors AS (
  SELECT DISTINCT p_brand AS ticker,
         'SEC' || cast(cast(regexp_replace(p_brand, '[^0-9]', '', 'g') AS int) % 4 AS varchar) AS sector
  FROM part)"""

MEMBERS = f"""members AS (
  SELECT {key_sql("S", "s_suppkey")} AS ticker FROM supplier WHERE s_suppkey % 10 <> 9
  UNION ALL SELECT n_name FROM nation)"""

_TRADE_ID = """lpad(cast(l_orderkey AS varchar), 14, '0') || '-' || cast(l_linenumber AS varchar) || '-' ||
      lpad(cast(l_partkey AS varchar), 12, '0') || '-' ||
      lpad(cast(cast(round(l_extendedprice * 100) AS bigint) AS varchar), 14, '0') || '-' ||
      lpad(cast(cast(round(l_discount * 100) AS bigint) AS varchar), 3, '0') || '-' ||
      lpad(cast(cast(round(l_tax * 100) AS bigint) AS varchar), 3, '0')"""

TRADES = f"""trades AS MATERIALIZED (
  SELECT strategy, symbol, side, qty, price, date, sec, id || sfx AS trade_id FROM (
    SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS strategy, {key_sql('S', 'l_suppkey')} AS symbol,
      'buy' AS side, l_quantity AS qty, px AS price, date, l_orderkey % 86400 AS sec, 'B' AS sfx, {_TRADE_ID} AS id FROM priced
    UNION ALL
    SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END, {key_sql('S', 'l_suppkey')},
      'sell', l_quantity, px * (1 + (l_partkey % 21 - 10) / 100.0::double), date + 30, l_orderkey % 86400, 'S', {_TRADE_ID}
    FROM priced WHERE l_returnflag = 'R'))"""

ORDER_FLOW = f"""flow AS MATERIALIZED (
  SELECT {key_sql('C', 'o_custkey')} AS account, 'P' || cast(l_partkey % 3 AS varchar) AS symbol,
    CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, l_quantity - 1.0 AS qty, px AS price, date, l_orderkey % 86400 AS sec,
    {_TRADE_ID} AS order_id FROM priced JOIN orders ON l_orderkey = o_orderkey)"""


def frame(n: int, key: str = "ticker", order: str = "date") -> str:
    return f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def over(key: str = "ticker", order: str = "date") -> str:
    return f"(PARTITION BY {key} ORDER BY {order})"


def run(key: str = "ticker", order: str = "date") -> str:
    return f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, need: int | None = None, key: str = "ticker") -> str:
    f = frame(n, key)
    return f"CASE WHEN count({x}) OVER {f} >= {need or n} THEN {agg}({x}) OVER {f} END"


def lagx(x: str, n: int = 1, key: str = "ticker") -> str:
    return f"lag({x}, {n}) OVER {over(key)}"


def ret_sql(n: int = 1, x: str = "close", key: str = "ticker") -> str:
    return f"({x} / nullif({lagx(x, n, key)}, 0) - 1)"


def r6(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0"


INDEX = "idx AS MATERIALIZED (SELECT 'IDX' AS index_id, date, avg(close) AS close FROM bars GROUP BY date)"


def regime_sql(n: int = 100, confirm: int = 3) -> str:
    """Continues a WITH list that holds idx; ends with regime(date, close, sma, above, run_len, bullish, streak)."""
    return f"""{INDEX},
reg0 AS (SELECT *, {roll("avg", "close", n, key="index_id")} AS sma FROM idx),
reg1 AS (SELECT *, close > sma AS above FROM reg0 WHERE sma IS NOT NULL),
reg2 AS (SELECT *, sum(chg) OVER (ORDER BY date) AS run_id FROM (
  SELECT *, CASE WHEN above = lag(above) OVER (ORDER BY date) THEN 0 ELSE 1 END AS chg FROM reg1)),
reg3 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY date) AS run_len FROM reg2),
reg4 AS (SELECT *, coalesce(last_value(CASE WHEN run_len >= {confirm} THEN above END IGNORE NULLS)
    OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS bullish FROM reg3),
regime AS MATERIALIZED (SELECT date, close, sma, above, run_len, run_id, bullish,
  CASE WHEN bullish AND above THEN run_len ELSE 0 END AS streak FROM reg4)"""


def with_(*ctes: str, body: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ctes) + "\n" + body
