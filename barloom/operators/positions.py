"""Rules over open positions: exits, entries, ageing, stops, barriers, cooldown."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import div, truthy
from ..schemas import ExitLimits
from ..sources.scratch import cut
from .rank import top_n


def exit_reasons(book: DataFrame, prices: DataFrame, z: DataFrame, spread_z: DataFrame,
                 limits: ExitLimits = ExitLimits()) -> DataFrame:
    """First exit rule that fires per position, NULL to stay.

    book: ticker, signal_type, direction, entry_price, entry_z, pair_partner, days_held;
    prices: ticker, price; z: ticker, z_now; spread_z: leg1, leg2, z (legs in either order).
    """
    key = lambda a, b: F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    sz = spread_z.select(key("leg1", "leg2").alias("_k"), F.col("z").alias("spread_now"))
    j = (
        book.join(prices.select("ticker", "price"), "ticker", "left")
        .join(z.select("ticker", "z_now"), "ticker", "left")
        .withColumn("_k", F.when(F.col("pair_partner").isNotNull(), key("ticker", "pair_partner")))
        .join(sz, "_k", "left")
    )
    pnl = (div("price", "entry_price") - 1) * F.col("direction")
    flipped = truthy(F.col("entry_z") * F.col("z_now") < 0)
    mr = F.col("signal_type") == "mean_reversion"
    pr = F.col("signal_type").isin("pairs_long", "pairs_short")
    mo = (F.col("signal_type") == "residual_momentum") & (F.col("days_held") >= limits.min_mom_days)
    return j.withColumn("pnl", pnl).withColumn(
        "exit_reason",
        F.when(F.col("price").isNull(), "delisted_or_missing")
        .when(mr & flipped, "z_reversal")
        .when(mr & (F.col("days_held") >= limits.max_mr_days), "time_stop")
        .when(mr & truthy(F.col("pnl") <= limits.stop_mr), "loss_stop")
        .when(pr & truthy(F.abs("spread_now") < limits.exit_pairs_z), "spread_close")
        .when(pr & (F.col("days_held") >= limits.max_pairs_days), "time_stop")
        .when(pr & truthy(F.col("pnl") <= limits.stop_pairs), "loss_stop")
        .when(mo & flipped, "mom_exit")
        .when(mo & truthy(F.col("pnl") <= limits.stop_mom), "loss_stop"),
    ).drop("_k")


def new_entries(signals: DataFrame, book: DataFrame, prices: DataFrame, date) -> DataFrame:
    """Positions to open: sized, not held, priced. The partner ticker travels along."""
    rows = signals.where(F.abs("position") >= 0.001).join(book.select("ticker"), "ticker", "left_anti")
    direction = F.when(F.col("position") > 0, 1).otherwise(-1)
    partner = F.col("partner") if "partner" in signals.columns else F.lit(None).cast("string")
    return rows.join(prices.select("ticker", "price"), "ticker").select(
        "ticker", F.when(F.col("signal_type") == "", "mean_reversion").otherwise(F.col("signal_type")).alias("signal_type"),
        direction.alias("direction"), F.lit(date).cast("date").alias("entry_date"), F.col("price").alias("entry_price"),
        (F.col("z_score") * direction).alias("entry_z"), F.abs("position").alias("size"),
        F.when(F.col("signal_type").contains("pairs"), partner).alias("pair_partner"), F.lit(0).alias("days_held"),
    )


def age_and_carry(book: DataFrame, signals: DataFrame, steps: int = 1) -> DataFrame:
    """Held names keep their size and type and grow older; others keep the fresh signal."""
    aged = book.select(
        "ticker", (F.col("size") * F.col("direction")).alias("_carry"), F.col("signal_type").alias("_type"),
        (F.col("days_held") + steps).alias("_days"),
    )
    return signals.join(aged, "ticker", "left").select(
        "ticker", F.coalesce("_carry", "position").alias("position"), F.coalesce("_type", "signal_type").alias("signal_type"),
        F.coalesce("_days", F.lit(0)).alias("days_held"),
    )


def book_summary(book: DataFrame) -> DataFrame:
    return book.select(
        "ticker", "signal_type", F.when(F.col("direction") == 1, "LONG").otherwise("SHORT FUT").alias("direction"),
        "entry_date", "days_held", F.round("size", 4).alias("size"), F.round("entry_z", 2).alias("entry_z"),
        F.coalesce("pair_partner", F.lit("")).alias("pair_partner"),
    )


def stop_target_exits(book: DataFrame, latest: DataFrame, max_hold: int = 60) -> DataFrame:
    """Stop, target and age check at the latest price. latest: ticker, date, close."""
    j = book.join(latest.select("ticker", F.col("date").alias("as_of"), "close"), "ticker")
    return j.withColumn("held_days", F.datediff("as_of", "entry_date")).withColumn(
        "pnl_pct", (div("close", "entry_price") - 1) * 100
    ).withColumn(
        "exit_reason",
        F.when(F.col("close") <= F.col("stop_loss"), "stop_loss").when(F.col("close") >= F.col("target"), "target")
        .when(F.col("held_days") >= max_hold, "max_hold"),
    )


def fill_slots(candidates: DataFrame, book: DataFrame, max_positions: int = 10, by: str = "score") -> DataFrame:
    """Best new names for the free slots of the book."""
    free = F.lit(max_positions) - book.agg(F.countDistinct("ticker").alias("n")).scalar()
    fresh = candidates.join(book.select("ticker"), "ticker", "left_anti").withColumn("_g", F.lit(0))
    return top_n(fresh, by, max_positions, ("_g",)).where(F.col("rank") <= free).drop("_g")


#: Rows after entries that are judged at a time.
JUDGED_ROWS = 1_000_000


def _as_spark_orders(x: pa.ChunkedArray) -> np.ndarray:
    """Missing becomes NaN, which meets no bound; a NaN lies above every number."""
    values = x.to_numpy()
    return np.where(np.isnan(values) & x.is_valid().to_numpy(), np.inf, values)


def barrier_exits(entries: DataFrame, bars: DataFrame, stop: float = 1.5, target: float = 2.5,
                  max_rows: int = 30) -> DataFrame:
    """First of stop, target, trend death or timeout after each entry.

    entries: ticker, entry_date, entry_price, atr; bars carry close, low, high and kama, atr_now.
    Entries of a day are reduced to their tightest bounds. These and the bars of a ticker, a row
    per day at most, meet in one group: bars move once, and no row after an entry is copied.
    """
    entries = cut(entries, "entries")
    bounds = entries.where(F.col("ticker").isNotNull() & F.col("entry_date").isNotNull()).groupBy("ticker", "entry_date").agg(
        F.max(F.col("entry_price") - stop * F.col("atr")).cast("double").alias("_stop"),
        F.min(F.col("entry_price") + target * F.col("atr")).cast("double").alias("_target"))
    rows = bars.where(F.col("ticker").isNotNull()).select(
        "ticker", "date", "close", F.col("low").cast("double").alias("_low"), F.col("high").cast("double").alias("_high"),
        truthy(F.col("close") < F.col("kama") - 0.5 * F.col("atr_now")).alias("_dead"))
    kinds = {f.name: f.dataType for f in [*entries.schema.fields, *bars.schema.fields]}
    schema = T.StructType([T.StructField("ticker", kinds["ticker"]), T.StructField("entry_date", kinds["entry_date"]), T.StructField("date", kinds["date"]),
                           T.StructField("reason", T.StringType()), T.StructField("close", kinds["close"]), T.StructField("step", T.IntegerType())])
    reasons = pa.array(["Stop Loss", "Target", "Trend Death", "Timeout"])

    def judged(asked: pa.Table, series: pa.Table) -> pa.Table:
        series = series.take(pc.sort_indices(series, sort_keys=[("date", "ascending")], null_placement="at_start")).combine_chunks()
        asked = asked.sort_by("entry_date").combine_chunks()
        # The rows of the series on which an entry is made, and its bounds.
        mine = pc.fill_null(pc.index_in(series["date"], asked["entry_date"].combine_chunks()), -1).to_numpy()
        at, n = np.flatnonzero(mine >= 0), series.num_rows
        low, high, dead = _as_spark_orders(series["_low"]), _as_spark_orders(series["_high"]), series["_dead"].to_numpy()
        floor, ceiling = _as_spark_orders(asked["_stop"])[mine[at]], _as_spark_orders(asked["_target"])[mine[at]]
        width = max(1, min(max_rows, n))
        steps = np.arange(1, width + 1)
        found, code = np.full(len(at), -1), np.zeros(len(at), np.int64)
        for i in range(0, len(at), size := max(1, JUDGED_ROWS // width)):
            part = slice(i, i + size)
            row = at[part, None] + steps
            there, row = row < n, np.minimum(row, n - 1)
            hits = [low[row] <= floor[part, None], high[row] >= ceiling[part, None], dead[row], np.broadcast_to(steps == max_rows, row.shape)]
            hit = there & np.logical_or.reduce(hits)
            first = hit.argmax(axis=1)
            pick = np.arange(len(first)), first
            found[part] = np.where(hit[pick], first + 1, -1)
            code[part] = np.stack([h[pick] for h in hits]).argmax(axis=0)
        live = found > 0
        exits = series.take(pa.array(at[live] + found[live]))
        return pa.table([exits["ticker"], asked["entry_date"].take(pa.array(mine[at[live]])), exits["date"], reasons.take(pa.array(code[live])), exits["close"],
                         pa.array(found[live].astype(np.int32))], names=schema.names)

    hits = bounds.groupBy("ticker").cogroup(rows.groupBy("ticker")).applyInArrow(judged, schema)
    first = hits.groupBy("ticker", "entry_date").agg(
        F.min_by(F.struct("date", "reason", "close", "step"), "step").alias("_x")
    )
    return entries.join(first, ["ticker", "entry_date"], "left").select(
        *entries.columns, F.col("_x.date").alias("exit_date"), F.col("_x.reason").alias("reason"),
        F.col("_x.close").alias("exit_close"), F.col("_x.step").alias("rows_held"),
    )


#: Entries of one ticker that a task takes up at a time, about.
ENTRY_CHUNK = 2048


class FirstPassage:
    """Blocks of 1, 2, 4, ... rows of a series, to find where a stop below the running peak is first met.

    A block knows its highest high, its lowest low, and whether a low in it meets the stop of a high
    before it in the block. With the peak up to the block that is all there is to ask, so a search
    skips whole blocks and reads a logarithmic number of them.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray, keep: float):
        size = 1 << max(0, len(high) - 1).bit_length()
        self.keep, self.top = keep, size.bit_length() - 1
        h, lo = np.full(size, -np.inf), np.full(size, np.inf)
        h[:len(high)], lo[:len(low)] = np.where(np.isnan(high), -np.inf, high), np.where(np.isnan(low), np.inf, low)
        hit, levels = np.zeros(size, bool), []
        while True:
            levels.append((h, lo, hit))
            if len(h) == 1:
                break
            hit = hit[::2] | hit[1::2] | (lo[1::2] <= h[::2] * keep)
            h, lo = np.maximum(h[::2], h[1::2]), np.minimum(lo[::2], lo[1::2])
        self.start = np.cumsum([0] + [len(x[0]) for x in levels])
        self.high, self.low, self.hit = (np.concatenate([x[i] for x in levels]) for i in range(3))

    def search(self, first: np.ndarray, peak: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """First row from `first` on that meets the stop (past the end: none), the peak before it, and the blocks read at most."""
        at, peak = first.astype(np.int64), peak.astype(float)
        level, size, rounds = np.zeros(len(at), np.int64), 1 << self.top, 0
        rising = np.ones(len(at), bool)
        while True:
            live = np.flatnonzero((at < size) & (rising | (level > 0)))
            if not len(live):
                return at, peak, rounds
            rounds += 1
            # Going down, the left half of a block that is met is asked; the right half is met if that is not.
            ask = np.where(rising[live], level[live], level[live] - 1)
            block = self.start[ask] + (at[live] >> ask)
            met = self.hit[block] | (self.low[block] <= peak[live] * self.keep)
            peak[live] = np.where(met, peak[live], np.maximum(peak[live], self.high[block]))
            at[live] += np.where(met, 0, 1 << ask)
            up = rising[live] & ~met & (at[live] % (1 << (ask + 1)) == 0) & (ask < self.top)
            level[live] = np.where(up, ask + 1, ask)
            rising[live] &= ~met


def trailing_stop(entries: DataFrame, bars: DataFrame, pct: float = 0.10, slip: float = 0.002,
                  max_rows: int | None = None) -> DataFrame:
    """First low at or below the running peak times (1 - pct); filled `slip` below the trigger.

    The peak is the entry price and the highs of the rows between entry and the day before. A ticker's
    series is one array, bounded by the calendar; it goes to its entries in chunks, so a ticker with a
    third of all entries is spread, and every entry reads a logarithmic number of blocks of its series.
    """
    series = bars.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "high", "low"))).alias("_s"))
    series = series.select("ticker", *[F.col(f"_s.{c}").alias(f"_{c}") for c in ("date", "high", "low")])
    chunks = entries.groupBy("ticker").agg(F.ceil(F.count(F.lit(1)) / ENTRY_CHUNK).alias("_n"))
    dealt = entries.join(chunks, "ticker").withColumn("_c", F.pmod(F.xxhash64("entry_date", "entry_price"), F.col("_n")))
    packed = dealt.groupBy("ticker", "_c").agg(F.collect_list(F.struct(*entries.columns)).alias("_e")).join(series, "ticker", "left")
    inner = packed.schema["_e"].dataType.elementType
    schema = T.StructType([*inner.fields, T.StructField("exit_date", bars.schema["date"].dataType), T.StructField("fill", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(2)[i].values
                cols = [rows.field(k) for k in range(rows.type.num_fields)]
                names = [f.name for f in rows.type]
                price = cols[names.index("entry_price")].cast(pa.float64()).to_numpy(zero_copy_only=False)
                exit_at, fill = np.full(len(rows), -1), np.full(len(rows), np.nan)
                dates = batch.column(3)[i].values
                if dates is not None:
                    day, asked = dates.to_numpy(zero_copy_only=False), cols[names.index("entry_date")].to_numpy(zero_copy_only=False)
                    high, low = (batch.column(k)[i].values.cast(pa.float64()).to_numpy(zero_copy_only=False) for k in (4, 5))
                    at = np.minimum(np.searchsorted(day, asked), len(day) - 1)
                    found, peak, _ = FirstPassage(high, low, 1 - pct).search(at + 1, np.where(np.isnan(price), -np.inf, price))
                    good = (day[at] == asked) & (found < len(day))
                    if max_rows is not None:
                        good &= found - at <= max_rows
                    exit_at, fill = np.where(good, found, -1), np.where(good, peak * (1 - pct) * (1 - slip), np.nan)
                    exits = dates.take(pa.array(exit_at, mask=exit_at < 0))
                else:
                    exits = pa.nulls(len(rows), batch.schema.field(3).type.value_type)
                yield pa.RecordBatch.from_arrays([*cols, exits, pa.array(fill, mask=exit_at < 0)], names=schema.names)

    return packed.select("ticker", "_c", "_e", "_date", "_high", "_low").mapInArrow(run, schema).select(*entries.columns, "exit_date", "fill")


def cooldown(entries: DataFrame, days: int = 5) -> DataFrame:
    """Keep an entry only when more than `days` have passed since the last kept one.

    Dropped entries do not restart the clock: a fold over a ticker's entry
    dates, at most one per calendar day.
    """
    state = "struct<last:date,kept:array<date>>"
    rows = entries.groupBy("ticker").agg(F.array_sort(F.collect_set("date")).alias("dates"))
    kept = F.aggregate(
        "dates",
        F.expr(f"cast(named_struct('last', cast(null as date), 'kept', array()) as {state})"),
        lambda acc, d: F.when(
            acc["last"].isNull() | (F.datediff(d, acc["last"]) > days),
            F.struct(d.alias("last"), F.array_append(acc["kept"], d).alias("kept")).cast(state),
        ).otherwise(acc),
        lambda a: a["kept"],
    )
    keys = rows.select("ticker", F.explode(kept).alias("date"))
    return entries.join(keys, ["ticker", "date"], "left_semi")


def momentum_exits(book: DataFrame, ind: DataFrame, atr_mult: float = 3.0, max_loss: float = 0.08) -> DataFrame:
    """Exit below the date's median momentum or under max(entry - k * ATR, entry * (1 - loss)).

    book: ticker, date, entry_price, atr; ind: ticker, date, close, mom, mom_median.
    """
    stop = F.greatest(F.col("entry_price") - atr_mult * F.col("atr"), F.col("entry_price") * (1 - max_loss))
    j = book.join(ind.select("ticker", "date", "close", "mom", "mom_median"), ["ticker", "date"])
    return j.withColumn("stop", stop).withColumn(
        "exit_reason",
        F.when(F.col("close") < F.col("stop"), "stop").when(truthy(F.col("mom") < F.col("mom_median")), "momentum"),
    )
