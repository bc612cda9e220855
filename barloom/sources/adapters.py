"""Market tables derived from the star-schema tables.

Tickers are suppliers (or brands), bars are the day's line items, orders and
trades are line items, ticks are the events. Everything is a projection, a join
or a partial aggregate, so the work grows with the tables and nothing is made
up. Prices are divided by a factor close to one so that no price sits exactly
between two rounded values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.regime import synthetic_index

OFF_TICK = 1.000003


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker_of(key: str):
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 10, "0"))


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with trading date, price and quantity."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_brand")
    drift = ((F.col("l_suppkey") * 7919) % 21 - 10) * F.datediff(
        F.col("date"), F.lit("1995-01-01").cast("date")
    ) / F.lit(100000.0)
    return (
        li.withColumn("date", F.col("l_shipdate").cast("date"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .withColumn(
            "px",
            F.col("p_retailprice") * (1 + F.col("l_discount") - F.col("l_tax")) * (1 + drift)
            / F.lit(OFF_TICK),
        )
    )


def _to_bars(lines: DataFrame, key: str) -> DataFrame:
    """OHLCV per (key, date), lines in order of (order, line number, price).

    Open and close are the price at the smallest and largest (position, price):
    partial aggregates, so a key with a third of all lines is reduced before the
    shuffle. Position and price are one decimal, a fixed-width buffer, so that
    lines are hashed and never sorted.
    """
    place = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    at = place.cast("decimal(19,0)") * F.lit(10**14).cast("decimal(15,0)") + F.floor(F.col("px") * 1e9).cast("decimal(15,0)")
    lines = lines.withColumn("_at", at)
    return lines.groupBy(key, "date").agg(
        F.min_by("px", "_at").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "_at").alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_bars(priced_lines(spark, sf_dir), "l_suppkey").select(
        ticker_of("l_suppkey").alias("ticker"), "date", "open", "high", "low", "close", "volume"
    )


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_bars(priced_lines(spark, sf_dir), "p_brand").withColumnRenamed("p_brand", "ticker")


def index_bars(spark: SparkSession, sf_dir: str, brands: bool = False) -> DataFrame:
    """index_id, date, close: mean close per date."""
    src = brand_bars(spark, sf_dir) if brands else bars(spark, sf_dir)
    return synthetic_index(src)


def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(ticker_of("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"))
    )


def brand_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand -> sector by the number in the brand name."""
    n = F.regexp_replace("p_brand", "[^0-9]", "").cast("int")
    return (
        table(spark, sf_dir, "part").select("p_brand").distinct()
        .select(F.col("p_brand").alias("ticker"), F.concat(F.lit("SEC"), n % 4).alias("sector"))
    )


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index members: nine of ten suppliers and the nations, which have no bars."""
    members = table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 9")
    return members.select(ticker_of("s_suppkey").alias("ticker")).unionByName(
        table(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker"))
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    every = lambda p: k % p == 0
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            ticker_of("s_suppkey").alias("ticker"),
            F.col("r_name").alias("sector"),
            (F.col("r_name") == "EUROPE").alias("is_finance"),
            every(11).alias("net_profit_negative"),
            every(13).alias("ebitda_negative"),
            F.when(k % 29 != 0, (k % 25 + 5).cast("double")).alias("roe"),
            ((k * 3) % 30 + 6).cast("double").alias("roce"),
            ((k % 7) / F.lit(3.0)).alias("debt_equity"),
            ((k % 9) / F.lit(2.0) + 0.25).alias("icr"),
            (k % 8).cast("double").alias("gross_npa_pct"),
            (k % 12 + 6).cast("double").alias("car_pct"),
            every(17).alias("revenue_decline_2yr"),
            (F.lit(20.0) + k % 50).alias("promoter_holding"),
            (k % 27).cast("double").alias("promoter_pledge"),
            every(19).alias("pledge_increasing_3q"),
            (F.col("s_acctbal") + 1000.0).alias("market_cap_cr"),
            every(23).alias("auditor_flag"),
            every(31).alias("promoter_selling"),
        )
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long statements per customer and year: ticker, year, item, value."""
    per = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey"), F.year("o_orderdate").alias("year"))
        .agg(F.sum("o_totalprice").alias("revenue"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    ebit = F.col("revenue") * 0.1 - F.col("c_acctbal") * 5
    items = {
        "revenue": F.col("revenue"),
        "ebit": ebit,
        "net_income": ebit * 0.7 - 5000.0,
        "interest": -(1.0 + F.col("o_custkey") % 50) * 100.003,
        "total_assets": F.col("revenue") * 0.9 + 5000.0,
        "current_liabilities": F.col("revenue") * 0.2,
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("item"), v.alias("value")) for n, v in items.items()])
    return per.select(
        F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 10, "0")).alias("ticker"),
        "year", F.explode(pairs).alias("p"),
    ).select("ticker", "year", "p.item", "p.value")


def _trade_id():
    return F.concat_ws(
        "-",
        F.lpad(F.col("l_orderkey").cast("string"), 14, "0"),
        F.col("l_linenumber").cast("string"),
        F.lpad(F.col("l_partkey").cast("string"), 12, "0"),
        F.lpad(F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), 14, "0"),
        F.lpad(F.round(F.col("l_discount") * 100).cast("long").cast("string"), 3, "0"),
        F.lpad(F.round(F.col("l_tax") * 100).cast("long").cast("string"), 3, "0"),
    )


def _clock(day: str):
    """Second of the day from the order key."""
    return F.expr(f"cast({day} AS timestamp_ntz) + make_dt_interval(0, 0, 0, l_orderkey % 86400)")


def _strategy():
    return F.when(F.col("l_suppkey") % 2 == 0, "A").otherwise("B")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted trades: each line is bought on its ship date; a returned line is sold
    again thirty days later, so a sale never exceeds what is held."""
    lines = priced_lines(spark, sf_dir)
    legs = F.array(
        F.struct(F.lit("buy").alias("side"), F.col("px").alias("price"),
                 F.col("date").alias("d"), F.lit("B").alias("sfx")),
        F.struct(F.lit("sell").alias("side"),
                 (F.col("px") * (1 + (F.col("l_partkey") % 21 - 10) / F.lit(100.0))).alias("price"),
                 F.date_add("date", 30).alias("d"), F.lit("S").alias("sfx")),
    )
    return (
        lines.select("l_suppkey", "l_returnflag", "l_quantity", "l_orderkey",
                     _strategy().alias("strategy"), _trade_id().alias("id"),
                     F.explode(legs).alias("leg"))
        .where((F.col("leg.side") == "buy") | (F.col("l_returnflag") == "R"))
        .select(
            "strategy", ticker_of("l_suppkey").alias("symbol"), "leg.side",
            F.col("l_quantity").alias("qty"), "leg.price",
            F.col("leg.d").alias("date"), _clock("leg.d").alias("ts"),
            F.concat("id", "leg.sfx").alias("trade_id"),
        )
    )


def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw order requests per account (customer); returned lines are sell requests,
    and neither cash nor shares are guaranteed."""
    lines = priced_lines(spark, sf_dir).join(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"),
        F.col("l_orderkey") == F.col("o_orderkey"),
    )
    return lines.select(
        F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 10, "0")).alias("account"),
        F.concat(F.lit("P"), (F.col("l_partkey") % 3).cast("string")).alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        (F.col("l_quantity") - 1.0).alias("qty"),
        F.col("px").alias("price"), "date", _clock("date").alias("ts"), _trade_id().alias("order_id"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"),
        "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"), "event_id",
    )


def futures(spark: SparkSession, sf_dir: str, b: DataFrame | None = None) -> DataFrame:
    """Bars with open interest: the base plus the volume of the last ten rows. b: bars that are written already."""
    from ..functions.windows import last_n

    b = (bars(spark, sf_dir) if b is None else b).select(F.col("ticker").alias("symbol"), "date", "close", "volume")
    # Named before the window, so that windows by symbol after it find their rows in place.
    return b.select(
        "symbol", "date", "close",
        (F.lit(1000.0) + F.sum("volume").over(last_n(10, "symbol"))).alias("open_int"),
        F.when(F.col("symbol").isin(*INDEX_TICKERS), "FUTIDX").otherwise("FUTSTK").alias("instrument"),
    )


INDEX_TICKERS = ("S0000000000", "S0000000001")
STRIKE_STEPS = tuple(range(-4, 5))


EXPIRIES, OPTION_TYPES = 3, 2


def chain_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the chain: a split of the line items becomes as many as a bar has quotes, so a task stays small at any size."""
    splits = table(spark, sf_dir, "lineitem").rdd.getNumPartitions()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), splits * len(STRIKE_STEPS) * EXPIRIES * OPTION_TYPES)


def options(spark: SparkSession, sf_dir: str, b: DataFrame | None = None, by: str = "date") -> DataFrame:
    """Chain: strikes around the money, three expiries, calls and puts.

    Bars are dealt by (symbol, date) before a bar becomes its quotes: what groups or
    joins the chain by these and further columns finds its rows in place, and only bars are moved.
    by: "month" deals them by (symbol, month) and gives the chain a column month, for what joins several days of
    a quote. b: bars that are written already.
    """
    from ..operators.derivatives import round_strike, strike_step

    b = (bars(spark, sf_dir) if b is None else b).select(F.col("ticker").alias("symbol"), "date", F.col("close").alias("spot"))
    place = [] if by == "date" else [by]
    if place:
        b = b.withColumn(by, F.trunc("date", by))
    b = b.repartition(chain_parts(spark, sf_dir), "symbol", by)
    month_end = F.last_day("date")
    expiries = F.array(month_end, F.date_add(month_end, 15), F.last_day(F.date_add(month_end, 1)))
    # What a bar's quotes share is worked out per bar, a price per strike and type, and the expiries come last.
    b = b.select("symbol", "date", *place, "spot", round_strike("spot").alias("at"), strike_step("spot").alias("step"), expiries.alias("expiries"))
    struck = b.withColumn("k", F.explode(F.array(*[F.lit(k) for k in STRIKE_STEPS]))).select(
        "symbol", "date", *place, "spot", "expiries", (F.col("at") + F.col("k") * F.col("step")).alias("strike"))
    fair = F.lit(0.02) * F.col("spot") / (1.0 + F.abs(F.col("strike") - F.col("spot")) / F.col("spot") * 50.0)
    struck = struck.withColumn("fair", fair).withColumn("option_type", F.explode(F.array(F.lit("CE"), F.lit("PE"))))
    intrinsic = F.when(F.col("option_type") == "CE", F.col("spot") - F.col("strike")).otherwise(
        F.col("strike") - F.col("spot")
    )
    premium = F.greatest(intrinsic, F.lit(0.0)) + F.col("fair")
    priced = struck.select("symbol", "date", *place, "option_type", "strike", "expiries", premium.alias("close"))
    return priced.select("symbol", "date", *place, "option_type", "strike", F.explode("expiries").alias("expiry_dt"),
                         "close", F.lit(50).alias("lot_size"))


def brand_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring brands (odd, even) as candidate pairs."""
    brands = table(spark, sf_dir, "part").select("p_brand").distinct().select(
        "p_brand", F.regexp_replace("p_brand", "[^0-9]", "").cast("int").alias("n")
    )
    odd = brands.where("n % 2 = 1").select(F.col("p_brand").alias("leg1"), F.col("n").alias("a"))
    even = brands.where("n % 2 = 0").select(F.col("p_brand").alias("leg2"),
                                            (F.col("n") - 1).alias("a"))
    return odd.join(even, "a").select(F.col("a").alias("pair_id"), "leg1", "leg2")
