"""Guarded row windows over keyed series.

Every series operator of the package uses the same partition and order, so
Catalyst plans a single exchange and a single sort however many indicators are
stacked on one frame.

Why a partition per ticker is safe: a bar table holds at most one row per
(ticker, date): merges, adapters and `unique_bars` enforce that with a partial
aggregate. A ticker therefore never has more rows than the calendar has days,
however much raw data sits behind it. Raw rows (trades, ticks, orders) have no
such bound and are pre-aggregated before they meet one of these windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col_of


def series(key="ticker", order="date"):
    keys = [key] if isinstance(key, str) else list(key)
    return W.partitionBy(*keys).orderBy(order)


def last_n(n: int, key="ticker", order="date"):
    return series(key, order).rowsBetween(-(n - 1), 0)


def to_date_window(key="ticker", order="date"):
    return series(key, order).rowsBetween(W.unboundedPreceding, 0)


def rolling(agg, col, n: int, min_periods: int | None = None, key="ticker", order="date") -> Column:
    """agg over the last n rows; NULL until min_periods non-null values exist."""
    w = last_n(n, key, order)
    col = col_of(col)
    return F.when(F.count(col).over(w) >= (n if min_periods is None else min_periods), agg(col).over(w))


def rolling2(agg, y, x, n: int, key="ticker", order="date") -> Column:
    """Two-column rolling aggregate, NULL until n complete pairs exist."""
    w = last_n(n, key, order)
    y, x = col_of(y), col_of(x)
    full = F.count(F.when(y.isNotNull() & x.isNotNull(), 1)).over(w) == n
    return F.when(full, agg(y, x).over(w))


def _last_rows(values: np.ndarray, known: np.ndarray, ends: np.ndarray, n: int, spread: bool) -> pa.Array:
    """Mean, or sample deviation, of the n rows up to each of `ends`; NULL unless all n are there and known."""
    out = np.full(len(ends), np.nan)
    seen = np.concatenate([[0], np.cumsum(known)])
    full = ends >= n - 1
    full[full] = seen[ends[full] + 1] - seen[ends[full] + 1 - n] == n
    if full.any():
        rows = np.lib.stride_tricks.sliding_window_view(values, n)[ends[full] - (n - 1)]
        with np.errstate(all="ignore"):
            if spread:
                # From the first row on, so that equal rows have a deviation of exactly zero.
                rows = rows - rows[:, :1]
                rows = rows - rows.mean(axis=1, keepdims=True)
                out[full] = np.sqrt((rows * rows).sum(axis=1) / (n - 1))
            else:
                out[full] = rows.mean(axis=1)
    return pa.array(out, mask=~full)


def rolling_at(df: DataFrame, keep: str, stats: dict[str, tuple[str, str, int]], columns: list[str], key="ticker", order="date") -> DataFrame:
    """The rows where `keep` is true: `columns`, and stats {name: ("avg" or "stddev_samp", column, n)} over their last n rows.

    As `rolling`, NULL until n non-null values exist. A moving frame is gone through
    anew for every row, which a month-end table needs for few of them; here only those are worked
    out. A series has a row per day at most, so it is one group.
    """
    cols = [c for _, c, _ in stats.values()]
    fields = [f for f in df.select(*columns).schema.fields]
    schema = T.StructType(fields + [T.StructField(name, T.DoubleType()) for name in stats])

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(order, "ascending")], null_placement="at_start"))
        ends = np.flatnonzero(rows[keep].to_numpy())
        out = rows.select(columns).take(pa.array(ends))
        arrays = {c: (rows[c].fill_null(0.0).to_numpy(), rows[c].is_valid().to_numpy()) for c in set(cols)}
        for name, (agg, c, n) in stats.items():
            out = out.append_column(name, _last_rows(*arrays[c], ends, n, agg == "stddev_samp"))
        return out

    sent = list(dict.fromkeys([key, order, keep, *columns, *cols]))
    return df.select(*sent).groupBy(key).applyInArrow(one, schema)


def lag(col, n: int = 1, key="ticker", order="date") -> Column:
    return F.lag(col_of(col), n).over(series(key, order))


def lead(col, n: int = 1, key="ticker", order="date") -> Column:
    return F.lead(col_of(col), n).over(series(key, order))


def running(agg, col, key="ticker", order="date") -> Column:
    return agg(col_of(col)).over(to_date_window(key, order))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one that comes last in `order`.

    max_by over a struct is a partial aggregate, so a key that is repeated a
    billion times is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    )
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def with_group_stats(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to every row.

    Pre-aggregate and join back instead of a window over the group: the group
    (a date, a sector) can be arbitrarily large, the aggregate is partial, and
    adaptive execution picks broadcast or a skew-split sort-merge join by the
    measured size of the aggregate.
    """
    stats = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(stats, keys, "left")


def with_totals(df: DataFrame, **aggs: Column) -> DataFrame:
    """Attach whole-table aggregates through one scalar subquery (no cross join)."""
    totals = df.agg(F.struct(*[a.alias(n) for n, a in aggs.items()]).alias("t")).scalar()
    out = df.withColumn("_t", totals)
    return out.select(*df.columns, *[F.col(f"_t.{n}").alias(n) for n in aggs])
