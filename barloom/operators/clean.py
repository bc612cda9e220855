"""Ingest, validation and cleaning of bars and fundamentals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import clean_number, div, finite, truthy
from ..functions.folds import fold
from ..functions.windows import keep_last, lag, series

MAX_JUMP = 0.25


def newer_than_stored(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows after the latest stored date; everything when nothing is stored."""
    mark = stored.agg(F.max("date")).scalar()
    return new.where(truthy(F.col("date") > mark) | mark.isNull())


def index_drift(members: DataFrame, bars: DataFrame) -> DataFrame:
    """Members without stored bars."""
    return members.select("ticker").distinct().join(bars.select("ticker").distinct(), "ticker", "left_anti")


def candle_reason(bars: DataFrame) -> DataFrame:
    """First failing candle rule, NULL for a sound candle."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    return bars.withColumn(
        "reason",
        F.when(c < 1, "close_below_one")
        .when(v == 0, "no_volume")
        .when(h < l, "high_below_low")
        .when((h < o) | (h < c), "high_below_body")
        .when((l > o) | (l > c), "low_above_body"),
    )


def validate_sequential(new: DataFrame, baseline: DataFrame | None = None,
                        max_jump: float = MAX_JUMP) -> DataFrame:
    """Candle rules, then the jump from the last accepted close.

    A rejected row does not move the baseline, so the rule is a recursion: a
    fold in the JVM over a ticker's rows, which the calendar bounds. Adds
    `reason` and `baseline` (the close the row was judged against).
    """
    flagged = candle_reason(new)
    rows = flagged.groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct("date", "close", "reason"))).alias("rows")
    )
    if baseline is None:
        rows = rows.withColumn("base", F.lit(None).cast("double"))
    else:
        rows = rows.join(baseline.select("ticker", F.col("close").alias("base")), "ticker", "left")

    def step(base, r):
        jump = truthy(F.abs(r["close"] / F.when(base > 0, base) - 1) > max_jump)
        kept = r["reason"].isNull() & ~jump
        return F.when(kept, r["close"]).otherwise(base), F.struct(base.alias("base"), jump.alias("jump"))

    out = (
        rows.withColumn("out", fold(F.col("rows"), F.col("base"), "double", "struct<base:double,jump:boolean>", step))
        .select("ticker", F.explode(F.arrays_zip("rows", "out")).alias("z"))
        .select("ticker", F.col("z.rows.date").alias("date"), F.col("z.out.base").alias("baseline"),
                F.col("z.out.jump").alias("_jump"))
    )
    return (
        flagged.join(out, ["ticker", "date"])
        .withColumn("reason", F.coalesce("reason", F.when(F.col("_jump"), "jump")))
        .drop("_jump")
    )


def jump_flag(bars: DataFrame, max_jump: float = MAX_JUMP) -> DataFrame:
    """Jump against the previous row, for audits."""
    return bars.withColumn("jump", truthy(F.abs(div("close", lag("close")) - 1) > max_jump))


def split_rejects(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with a readable message)."""
    ok = flagged.where(F.col("reason").isNull()).drop("reason", "baseline")
    bad = flagged.where(F.col("reason").isNotNull()).select(
        "ticker", "date", "reason",
        F.format_string("%s on %s: %s (close %.2f)", "ticker", F.col("date").cast("string"), "reason",
                        "close").alias("message"),
    )
    return ok, bad


def merge_bars(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Append with the new row winning on a repeated (ticker, date)."""
    both = stored.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return keep_last(both, ["ticker", "date"], ["_src"]).drop("_src")


def added_rows(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row: stored, incoming and added counts of a merge."""
    both = stored.select("ticker", "date", F.lit(1).alias("s"), F.lit(0).alias("n")).unionByName(
        new.select("ticker", "date", F.lit(0).alias("s"), F.lit(1).alias("n"))
    )
    per = both.groupBy("ticker", "date").agg(F.max("s").alias("s"), F.max("n").alias("n"))
    return per.agg(
        F.sum("s").alias("stored"), F.sum("n").alias("incoming"),
        F.count_if((F.col("n") == 1) & (F.col("s") == 0)).alias("added"),
    )


def replace_tickers(stored: DataFrame, new: DataFrame, tickers: DataFrame) -> DataFrame:
    """Drop every stored row of the named tickers and take the new ones."""
    return stored.join(tickers, "ticker", "left_anti").unionByName(
        new.join(tickers, "ticker", "left_semi")
    )


def flat_series(bars: DataFrame, year: int, min_std: float = 0.1) -> DataFrame:
    """Tickers whose close hardly moves in a year."""
    y = bars.where(F.col("date").between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")))
    return y.groupBy("ticker").agg(F.stddev_samp("close").alias("std_close")).where(
        F.col("std_close") < min_std
    )


def stitch_history(legacy: DataFrame, current: DataFrame, rename: DataFrame | None = None,
                   min_std: float = 0.1) -> DataFrame:
    """Legacy rows before the first current date, then current rows.

    Where current is flat or absent the whole legacy series is taken. `rename`
    maps old to new ticker names (old, new).
    """
    if rename is not None:
        legacy = (
            legacy.join(rename.select(F.col("old").alias("ticker"), "new"), "ticker", "left")
            .withColumn("ticker", F.coalesce("new", "ticker")).drop("new")
        )
    facts = current.groupBy("ticker").agg(
        F.min("date").alias("_first"), F.stddev_samp("close").alias("_std")
    ).withColumn("_flat", truthy(F.col("_std") < min_std))
    has_legacy = legacy.select("ticker").distinct().withColumn("_l", F.lit(True))
    old = legacy.join(facts, "ticker", "left").where(
        F.col("_first").isNull() | F.col("_flat") | (F.col("date") < F.col("_first"))
    )
    new = current.join(facts, "ticker").join(has_legacy, "ticker", "left").where(
        ~F.col("_flat") | F.col("_l").isNull()
    )
    cols = legacy.columns
    return old.select(*cols).unionByName(new.select(*cols))


def frozen_by_year(bars: DataFrame, cv_max: float = 0.01) -> DataFrame:
    """ticker, year with a coefficient of variation below the limit."""
    cv = div(F.stddev_samp("close"), F.avg("close"))
    return (
        bars.groupBy("ticker", F.year("date").alias("year")).agg(cv.alias("cv"))
        .where(F.col("cv") < cv_max)
    )


def valid_candles(index_bars: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return index_bars.where((h >= F.greatest(o, c)) & (l <= F.least(o, c)))


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to double; rows with a bad cell are dropped."""
    for c in cols:
        df = df.withColumn(c, finite(F.col(c).try_cast("double")))
    return df.dropna(subset=cols)


def ffill(df: DataFrame, cols: list[str], key="ticker", order="date") -> DataFrame:
    w = series(key, order).rowsBetween(W.unboundedPreceding, 0)
    for c in cols:
        df = df.withColumn(c, F.last(c, ignorenulls=True).over(w))
    return df


def fill_forward(bars: DataFrame, key="ticker", order="date") -> DataFrame:
    """Each series on every date of the table from its first row on, rows repeated until the next one.

    A row is repeated in place over the dates up to its follower: no key x date grid is joined.
    The calendar is one array, a few thousand dates at any data size.
    """
    dates = bars.select(order).distinct()
    days = dates.agg(F.array_sort(F.collect_list(order)).alias("a"))
    place = days.select(F.posexplode("a").alias("_at", order))
    rows = bars.join(place, order)
    until = F.lead("_at").over(series(key, "_at"))
    last = days.select(F.size("a").alias("n")).scalar()
    filled = rows.withColumn("_to", F.coalesce(until, last) - 1).withColumn("_at", F.explode(F.sequence("_at", "_to")))
    return filled.drop(order, "_to").join(place, "_at").select(*bars.columns)


def ffill_bfill(df: DataFrame, cols: list[str], key="ticker", order="date") -> DataFrame:
    """Last known value, else the first later one.

    The backward value is a running `last` over the descending order, which
    costs one pass; a frame to the end of the partition would be quadratic.
    """
    keys = [key] if isinstance(key, str) else list(key)
    back = W.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    fwd = series(key, order).rowsBetween(W.unboundedPreceding, 0)
    for c in cols:
        df = df.withColumn(
            c, F.coalesce(F.last(c, ignorenulls=True).over(fwd), F.last(c, ignorenulls=True).over(back))
        )
    return df


def sanitise(df: DataFrame, defaults: dict[str, float | None], zero_is_missing: bool = True) -> DataFrame:
    for c, v in defaults.items():
        df = df.withColumn(c, clean_number(c, v, zero_is_missing))
    return df


def to_wide(bars: DataFrame, names: list[str], value: str = "close") -> DataFrame:
    """Date by ticker matrix, for reports. Names are required: columns must not depend on what the driver finds."""
    return bars.groupBy("date").pivot("ticker", names).agg(F.first(value, ignorenulls=True))


def merge_fundamentals(fetched: DataFrame, stored: DataFrame, manual_cols: list[str]) -> DataFrame:
    """Fetched rows, keeping stored manual values where present."""
    old = stored.select("ticker", *[F.col(c).alias(f"_old_{c}") for c in manual_cols])
    out = fetched.join(old, "ticker", "left")
    for c in manual_cols:
        out = out.withColumn(c, F.coalesce(f"_old_{c}", c)).drop(f"_old_{c}")
    return out


def statement_ratios(statements: DataFrame) -> DataFrame:
    """ROCE, interest cover, two-year revenue decline and losses per ticker, at the latest year."""
    item = lambda n: F.max(F.when(F.col("item") == n, F.col("value")))
    per = statements.groupBy("ticker", "year").agg(
        *[item(n).alias(n) for n in
          ("revenue", "ebit", "net_income", "interest", "total_assets", "current_liabilities")]
    )
    w = W.partitionBy("ticker").orderBy("year")
    prev = lambda c, n: F.lag(c, n).over(w)
    rows = per.withColumn(
        "revenue_decline_2yr",
        truthy((F.col("revenue") < prev("revenue", 1)) & (prev("revenue", 1) < prev("revenue", 2))),
    ).withColumn(
        "loss_either_year", truthy(F.col("net_income") < 0) | truthy(prev("net_income", 1) < 0)
    ).withColumn("_last", F.row_number().over(W.partitionBy("ticker").orderBy(F.col("year").desc())))
    return rows.where(F.col("_last") == 1).select(
        "ticker", "year",
        (div("ebit", F.col("total_assets") - F.col("current_liabilities")) * 100).alias("roce"),
        div("ebit", F.abs("interest")).alias("icr"),
        "revenue_decline_2yr", "loss_either_year",
    )


def fundamentals_summary(f: DataFrame) -> DataFrame:
    """Data-quality counts."""
    return f.agg(
        F.count(F.lit(1)).alias("names"),
        F.count_if(truthy("net_profit_negative")).alias("net_loss"),
        F.count_if(truthy("ebitda_negative")).alias("ebitda_loss"),
        F.count_if(F.col("roe").isNull()).alias("roe_missing"),
        F.count_if(truthy(F.col("roe") < 8)).alias("roe_low"),
        F.count_if(truthy(F.col("roce") < 10)).alias("roce_low"),
        F.count_if(truthy(F.col("debt_equity") > 1.5)).alias("debt_high"),
        F.count_if(truthy("is_finance")).alias("finance"),
    )
