"""Streaming operators: windows, last values, deduplication and keyed state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import in_market_hours
from ..operators.clean import MAX_JUMP, candle_reason
from ..operators.ledger import FLAT


def stream_bars(ticks: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Tumbling OHLCV per symbol. Ticks: symbol, ts, price, volume, event_id."""
    order = F.struct("ts", "event_id")
    return (
        ticks.withWatermark("ts", delay)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")
    )


def stream_snapshots(values: DataFrame, width: str = "30 minutes", delay: str = "1 hour",
                     open_minute: int = 555, close_minute: int = 930) -> DataFrame:
    """Last value per portfolio and interval, inside market hours only."""
    return (
        values.where(in_market_hours("ts", open_minute, close_minute)).withWatermark("ts", delay)
        .groupBy("portfolio", F.window("ts", width).alias("w"))
        .agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
        .select("portfolio", F.col("w.start").alias("start"), "value")
    )


def stream_last_price(ticks: DataFrame) -> DataFrame:
    """Run in update mode; the state holds one row per symbol."""
    return ticks.groupBy("symbol").agg(
        F.max_by("price", F.struct("ts", "event_id")).alias("price"), F.max("ts").alias("updated_at")
    )


def stream_dedup(df: DataFrame, keys: list[str], delay: str = "1 day", ts: str = "ts") -> DataFrame:
    """Re-delivered rows within the delay are dropped; older keys leave the state."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_sliding_mean(ticks: DataFrame, value: str, width: str = "20 days", slide: str = "1 day",
                        delay: str = "1 day") -> DataFrame:
    """Time-based mean, the event-time relative of the n-row mean. Run in update mode.

    The state of a symbol is the sums of the steps that lie in windows still open, not a row per window:
    a tick moves and is stored once, not once for each of its windows. A window ends when the watermark had
    passed its end as its symbol came last; later ticks leave it as it is.
    """
    wide, step = (_micros(ticks.sparkSession, x) for x in (width, slide))
    unit = math.gcd(wide, step)
    at = F.unix_micros("ts")
    rows = ticks.withWatermark("ts", delay).where(F.col("ts").isNotNull()).select(
        "symbol", "ts", (at - F.pmod(at, F.lit(unit))).alias("at"), F.col(value).cast("double").alias("value"),
        F.col(value).isNotNull().cast("long").alias("valid"), F.lit(1).cast("long").alias("n"),
    )
    state_schema = "at array<long>, total array<double>, valid array<long>, n array<long>, ended long"

    def summed(at, total, valid, n):
        days, of = np.unique(at, return_inverse=True)
        add = lambda x: np.bincount(of, weights=x, minlength=len(days))
        return days, add(total), add(valid), add(n)

    def slid(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *kept, ended = state.get if state.exists else ([], [], [], [], 0)
        kept = [np.array(x, t) for x, t in zip(kept, (np.int64, float, float, float))]
        new = np.empty(0, np.int64)
        for pdf in batches:
            valid = pdf.valid.to_numpy()
            more = summed(pdf["at"].to_numpy(), np.where(valid > 0, pdf.value.to_numpy(), 0.0), valid, pdf.n.to_numpy())
            new = np.union1d(new, more[0])
            kept = summed(*(np.concatenate(x) for x in zip(kept, more)))
        days, total, valid, n = kept
        first = days - days % step + wide
        # Every window of a new step: its last one, and those before it that reach up to the step.
        ends = (new - new % step + wide)[:, None] - np.arange(-(-wide // step)) * step
        ends = np.unique(ends[(ends > new[:, None]) & (ends > ended)])
        if len(ends):
            spans = np.column_stack([np.searchsorted(days, ends - wide), np.searchsorted(days, ends)]).ravel()
            over = lambda x: np.add.reduceat(np.append(x, 0.0), spans)[::2]
            yield pd.DataFrame({"symbol": pd.Series([key[0]] * len(ends), dtype=object), "end": ends, "total": over(total),
                                "valid": over(valid).astype(np.int64), "n": over(n).astype(np.int64)})
        ended = max(ended, state.getCurrentWatermarkMs() * 1000)
        still = first > ended
        state.update((days[still].tolist(), total[still].tolist(), valid[still].astype(np.int64).tolist(), n[still].astype(np.int64).tolist(), int(ended)))

    out = rows.groupBy("symbol").applyInPandasWithState(
        slid, "symbol string, end long, total double, valid long, n long", state_schema, "update", GroupStateTimeout.NoTimeout
    )
    # Pandas hands a sum that is not a number back as null.
    mean = F.when(F.col("valid") > 0, F.coalesce("total", F.lit(float("nan"))) / F.col("valid"))
    return out.select("symbol", F.timestamp_micros("end").alias("end"), mean.alias("mean"), "n")


def _micros(spark: SparkSession, span: str) -> int:
    """Microseconds of a span of days, hours and less."""
    return spark.range(1).select(F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00 UTC' + interval {span})")).first()[0]


def stream_entry_bursts(entries: DataFrame, gap: str = "5 days", delay: str = "1 day") -> DataFrame:
    """Entries of a ticker closer than the gap form one burst (append mode)."""
    return (
        entries.withWatermark("ts", delay)
        .groupBy("ticker", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("entries"))
        .select("ticker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "entries")
    )


def stream_validate(candles: DataFrame, max_jump: float = MAX_JUMP) -> DataFrame:
    """Candle rules in the JVM, then the jump rule against the last accepted close per ticker.

    The state is two numbers per ticker: that close and its date. Rows of a ticker
    inside one micro-batch are put in date order before they are judged. Across
    batches dates must rise: a row on or before the last accepted date of an earlier
    batch comes too late to be judged against its own past and is rejected as 'stale'.
    """
    rows = candle_reason(candles).select("ticker", "date", "close", "reason")
    schema = "ticker string, date date, close double, reason string"

    def judge(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        base, last = state.get if state.exists else (None, None)
        before = last
        pdf = pd.concat(list(batches)).sort_values("date", kind="stable")
        reasons = []
        for day, close, reason in zip(pdf.date, pdf.close, pdf.reason):
            why = reason if isinstance(reason, str) else None
            at = pd.Timestamp(day).toordinal()
            if why is None and before is not None and at <= before:
                why = "stale"
            if why is None and base is not None and base > 0 and abs(close / base - 1) > max_jump:
                why = "jump"
            if why is None:
                base, last = float(close), at
            reasons.append(why)
        if base is not None:
            state.update((base, last))
        yield pdf.assign(reason=pd.Series(reasons, index=pdf.index, dtype=object))

    return rows.groupBy("ticker").applyInPandasWithState(
        judge, schema, "base double, last long", "append", GroupStateTimeout.NoTimeout
    )


def stream_positions(trades: DataFrame) -> DataFrame:
    """Quantity and average cost per (strategy, symbol) after each micro-batch.

    The state is three numbers per key that has ever traded: a flat position keeps
    its count of trades.
    """
    schema = "strategy string, symbol string, qty double, avg_cost double, trades long"

    def replay(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        qty, avg, n = state.get if state.exists else (0.0, 0.0, 0)
        pdf = pd.concat(list(batches)).sort_values(["ts", "trade_id"], kind="stable")
        for side, q, price in zip(pdf.side, pdf.qty, pdf.price):
            n += 1
            if side == "buy":
                avg = (qty * avg + q * price) / (qty + q)
                qty += q
            else:
                qty -= q
                if qty < FLAT:
                    qty, avg = 0.0, 0.0
        state.update((float(qty), float(avg), int(n)))
        yield pd.DataFrame({"strategy": [key[0]], "symbol": [key[1]], "qty": [qty], "avg_cost": [avg], "trades": [n]})

    return trades.groupBy("strategy", "symbol").applyInPandasWithState(
        replay, schema, "qty double, avg double, n long", "update", GroupStateTimeout.NoTimeout
    )
