"""SQL of the option chain shared by calendar, join and derivative queries."""

STEP = """(CASE WHEN {p} > 10000 THEN 100 WHEN {p} > 1000 THEN 50 WHEN {p} > 500 THEN 10 ELSE 5 END)"""


def round_strike(p: str) -> str:
    st = STEP.format(p=p)
    return f"(round_even(({p}) / {st}::double, 0) * {st})"


OPTIONS = f"""chain AS MATERIALIZED (SELECT symbol, date, option_type, strike, expiry_dt, 50 AS lot_size,
  greatest(CASE WHEN option_type = 'CE' THEN spot - strike ELSE strike - spot END, 0.0::double)
    + 0.02::double * spot / (1.0::double + abs(strike - spot) / spot * 50.0::double) AS close
  FROM (SELECT ticker AS symbol, date, close AS spot, k, expiry_dt, option_type,
      {round_strike('close')} + k * {STEP.format(p='close')} AS strike
    FROM bars, (SELECT unnest(range(-4, 5)) AS k), (SELECT unnest(['CE', 'PE']) AS option_type),
      LATERAL (SELECT unnest([last_day(date), last_day(date) + 15, last_day(last_day(date) + 1)]) AS expiry_dt)))"""

FUTURES = """fut AS MATERIALIZED (SELECT ticker AS symbol, date, close, 1000.0::double + sum(volume) OVER (PARTITION BY ticker ORDER BY date
    ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS open_int,
  CASE WHEN ticker IN ('S0000000000', 'S0000000001') THEN 'FUTIDX' ELSE 'FUTSTK' END AS instrument FROM bars)"""
