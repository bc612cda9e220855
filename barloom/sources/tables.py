"""Typed readers and sinks for bars, dimensions, ledgers and signal documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.windows import keep_last


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Parquet bars with the declared schema; filters and columns are pushed down."""
    return spark.read.schema(S.BARS).parquet(path)


def unique_bars(bars: DataFrame, order: list[str]) -> DataFrame:
    """One row per (ticker, date) for bars of unknown origin: the bound the windows rest on."""
    return keep_last(bars, ["ticker", "date"], order)


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by year; one shuffle clusters a year's tickers into few files.

    With mode "overwrite" only the years present in `bars` are replaced.
    """
    (
        bars.withColumn("year", F.year("date"))
        .repartition("year", F.pmod(F.xxhash64("ticker"), F.lit(16)))
        .sortWithinPartitions("year", "ticker", "date")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def last_close(bars: DataFrame, ticker: str) -> DataFrame:
    """Last close of one ticker; the filter reaches the scan."""
    return (
        bars.where(F.col("ticker") == ticker)
        .groupBy("ticker")
        .agg(F.max_by("close", "date").alias("close"), F.max("date").alias("date"))
    )


def latest_slice(bars: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Rows of the latest date, optionally only for a set of tickers."""
    out = bars.where(F.col("date") == bars.agg(F.max("date")).scalar())
    return out if tickers is None else out.join(tickers, "ticker", "left_semi")


def read_dim(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_fundamentals(spark: SparkSession, path: str, defaults: dict | None = None) -> DataFrame:
    """CSV with declared types; missing cells take the per-column default."""
    return with_defaults(read_dim(spark, path, S.FUNDAMENTALS), defaults or FUNDAMENTAL_DEFAULTS)


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    return df.fillna({c: v for c, v in defaults.items() if c in df.columns})


# What a missing cell counts as in the gate rules.
FUNDAMENTAL_DEFAULTS = {
    "net_profit_negative": False, "ebitda_negative": False, "roe": 999.0, "roce": 999.0,
    "revenue_decline_2yr": False, "promoter_holding": 100.0, "promoter_pledge": 0.0,
    "pledge_increasing_3q": False, "market_cap_cr": 99999.0, "auditor_flag": False,
    "promoter_selling": False, "is_finance": False, "debt_equity": 0.0, "icr": 999.0,
    "gross_npa_pct": 0.0, "car_pct": 999.0,
}


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Documents as write_signals stores them: one per line, any number per file."""
    return spark.read.schema(S.SIGNALS_DOC).json(path)


def held_from_signals(doc: DataFrame, labels: tuple[str, ...] | None = ("BUY", "HOLD")) -> DataFrame:
    """Tickers of a signal document; labels=None keeps every listed ticker."""
    rows = doc.select(F.explode("signals").alias("s")).select("s.*")
    if labels:
        rows = rows.where(F.col("signal").isin(*labels))
    return rows.select("ticker").distinct()


def signals_document(sized: DataFrame, header: dict) -> DataFrame:
    """One nested row: header, signal structs in slot order, sector map.

    `sized` is the selection of one screen (top-n plus buffer), so the arrays
    are bounded by the buffer size.
    """
    rows = sized.agg(
        F.sort_array(F.collect_list(F.struct("slot", *S.SIGNAL.names))).alias("_s"),
        F.array_sort(F.collect_set("sector")).alias("_sec"),
    )
    fields = ", ".join(f"'{c}', x.{c}" for c in S.SIGNAL.names)
    return rows.select(
        *[F.lit(header.get(k)).cast(t).alias(k) for k, t in
          [("nifty_level", "double"), ("regime", "string"), ("scanned_date", "string"),
           ("portfolio_value", "double")]],
        F.expr(f"transform(_s, x -> named_struct({fields}))").alias("signals"),
        F.expr("map_from_arrays(_sec, transform(_sec, x -> named_struct('avg_score', 99, "
               "'signal', 'Bullish')))").alias("sector_stats"),
        F.struct(
            F.lit(bool(header.get("breaker_tripped", False))).alias("breaker_tripped"),
            F.lit(bool(header.get("kill_switch_active", False))).alias("kill_switch_active"),
        ).alias("system_status"),
    )


def empty_signals_document(spark: SparkSession, header: dict) -> DataFrame:
    empty = spark.createDataFrame([], T.StructType([T.StructField("slot", T.IntegerType()),
                                                    *S.SIGNAL.fields]))
    return signals_document(empty, header)


def write_signals(doc: DataFrame, path: str) -> None:
    doc.write.mode("overwrite").json(path)


def read_ledger(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(S.LEDGER_TABLES[table]).parquet(f"{root}/{table}")


def write_ledger(df: DataFrame, root: str, table: str, mode: str = "append") -> None:
    S.check_columns(df, S.LEDGER_TABLES[table]).write.mode(mode).parquet(f"{root}/{table}")


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace stored rows of the same key."""
    both = table.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)))
    return keep_last(both, keys, ["_src"]).drop("_src")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    return read_dim(spark, path, S.JOURNAL)
