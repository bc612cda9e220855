"""Column-level helpers: missing values, safe division, text and dates.

Missing is always NULL here. NaN and infinities are turned into NULL where a
number enters, because Spark orders NaN above every number and treats
NaN = NaN as true, which would silently pass the gates.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col_of(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def div(num, den) -> Column:
    """num / den, NULL when the denominator is zero or missing."""
    num, den = col_of(num), col_of(den)
    return num / F.nullif(den, F.lit(0.0))


def truthy(flag) -> Column:
    """A missing flag counts as False."""
    return F.coalesce(col_of(flag), F.lit(False))


def finite(col) -> Column:
    """NaN and +-inf become NULL."""
    col = col_of(col)
    return F.when(~F.isnan(col) & (col != INF) & (col != -INF), col)


def clean_number(col, default: float | None = None, zero_is_missing: bool = False) -> Column:
    """Sanitise a double: non-finite (and optionally zero) to NULL, then a default."""
    out = finite(col)
    if zero_is_missing:
        out = F.nullif(out, F.lit(0.0))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def clip(col, lo, hi) -> Column:
    return F.greatest(F.least(col_of(col), F.lit(hi)), F.lit(lo))


def rnd(col, places: int = 6) -> Column:
    """Rounded for reports; adding zero turns a negative zero into zero."""
    return F.round(col_of(col), places) + F.lit(0.0)


def add_suffix(col, sfx: str) -> Column:
    col = col_of(col)
    return F.when(col.contains(sfx), col).otherwise(F.concat(col, F.lit(sfx)))


def strip_suffix(col, sfx: str) -> Column:
    return F.replace(col_of(col), F.lit(sfx), F.lit(""))


def parse_date_any(col, formats: tuple[str, ...]) -> Column:
    """First format that parses wins; nothing parses -> NULL."""
    col = col_of(col)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(col, F.lit(f))) for f in formats])


def normalise_date(col) -> Column:
    """Drop time of day and zone."""
    return F.to_date(col_of(col))


def days_between(start, end) -> Column:
    return F.datediff(col_of(end), col_of(start))


def is_quarter_start(date_col) -> Column:
    """First seven days of January, April, July and October."""
    d = col_of(date_col)
    return F.month(d).isin(1, 4, 7, 10) & (F.dayofmonth(d) <= 7)


def in_market_hours(ts, open_minute: int = 555, close_minute: int = 930) -> Column:
    """Weekday between the opening and closing minute of the day, both included."""
    ts = col_of(ts)
    minute = F.hour(ts) * 60 + F.minute(ts)
    return (F.weekday(ts) < 5) & minute.between(open_minute, close_minute)
