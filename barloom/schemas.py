"""Explicit schemas of every table and the parameter sets of the strategies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "date": T.DateType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(),
    "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
}


def schema(**cols: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in cols.items()])


BARS = schema(ticker="string", date="date", open="double", high="double", low="double",
              close="double", volume="double")
INDEX_BARS = schema(index_id="string", date="date", open="double", high="double", low="double",
                    close="double")
SECTOR_MAP = schema(symbol="string", sector="string")
UNIVERSE = schema(symbol="string")
FUNDAMENTALS = schema(
    ticker="string", sector="string", is_finance="boolean", net_profit_negative="boolean",
    ebitda_negative="boolean", roe="double", roce="double", debt_equity="double", icr="double",
    gross_npa_pct="double", car_pct="double", revenue_decline_2yr="boolean",
    promoter_holding="double", promoter_pledge="double", pledge_increasing_3q="boolean",
    market_cap_cr="double", auditor_flag="boolean", promoter_selling="boolean",
    last_updated="date", data_source="string", fetch_error="string",
)
TRADES = schema(strategy="string", symbol="string", side="string", qty="double", price="double",
                ts="timestamp_ntz", trade_id="string")
POSITIONS = schema(strategy="string", symbol="string", qty="double", avg_cost="double")
SNAPSHOTS = schema(strategy="string", date="date", portfolio_value="double", cash="double",
                   daily_pnl="double", daily_pnl_pct="double")
PRICE_CACHE = schema(symbol="string", price="double", updated_at="timestamp_ntz")
JOURNAL = schema(ticker="string", entry_date="date", exit_date="date", entry_price="double",
                 exit_price="double", score="double", reason="string", return_pct="double",
                 capital_allocated="double", position_size_pct="double", profit_amount="double")
TICKS = schema(symbol="string", ts="timestamp_ntz", price="double", volume="double")

SIGNAL = schema(ticker="string", sector="string", signal="string", price="double",
                hold_period="string", allocation_pct="double", max_volume_shrs="long",
                target_shrs="long", tech_status="string")
SIGNALS_DOC = T.StructType([
    T.StructField("nifty_level", T.DoubleType()),
    T.StructField("regime", T.StringType()),
    T.StructField("scanned_date", T.StringType()),
    T.StructField("portfolio_value", T.DoubleType()),
    T.StructField("signals", T.ArrayType(SIGNAL)),
    T.StructField("sector_stats", T.MapType(
        T.StringType(), schema(avg_score="int", signal="string"))),
    T.StructField("system_status", schema(breaker_tripped="boolean", kill_switch_active="boolean")),
])

LEDGER_TABLES = {"trades": TRADES, "positions": POSITIONS, "daily_snapshots": SNAPSHOTS,
                 "price_cache": PRICE_CACHE}


def check_columns(df: DataFrame, want: T.StructType) -> DataFrame:
    """Project to the declared columns; raise when one is missing or mistyped."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in want.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {wrong}")
    return df.select(*want.names)


# Parameters that must equal the published strategy settings.
@dataclass(frozen=True)
class ScreenParams:
    top_n: int = 5
    hold_buffer: int = 15
    regime_sma: int = 100
    confirm_days: int = 3
    min_turnover: float = 1e7
    min_price: float = 10.0
    bear_momentum: float = 0.20
    position_cap: float = 0.30
    volume_cap: float = 0.05
    leverage: float = 1.10
    reentry_streak: int = 22


@dataclass(frozen=True)
class BreakerLimits:
    month_loss: float = -0.08
    kill_drawdown: float = -0.20
    cooloff_days: int = 25
    month_days: int = 20


@dataclass(frozen=True)
class ExitLimits:
    max_mr_days: int = 15
    stop_mr: float = -0.03
    max_pairs_days: int = 30
    exit_pairs_z: float = 0.50
    stop_pairs: float = -0.04
    min_mom_days: int = 21
    stop_mom: float = -0.05


@dataclass(frozen=True)
class FundamentalLimits:
    roe_min: float = 8.0
    roce_min: float = 10.0
    holding_min: float = 25.0
    pledge_max: float = 20.0
    market_cap_min: float = 500.0
    debt_equity_max: float = 1.5
    icr_min: float = 1.5
    npa_max: float = 5.0
    car_min: float = 12.0


@dataclass(frozen=True)
class FactorParams:
    lookback: int = 252
    #: Common rows that a pair needs.
    pair_rows: int = 200
    z_entry: float = 2.0
    max_position: float = 0.03
    cost: float = 0.0010
    roll_daily: float = 0.003 / 21
    liquidity_rank: int = 200
    #: Last dates on which a name needs a close, one and a half times the lookback.
    history_rows: int = 378
    min_confidence: float = 0.55
    weights: tuple[float, float, float] = (0.40, 0.35, 0.25)
