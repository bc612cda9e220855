"""Ranking, sorting and top-k. The ticker is always the last sort key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.orderstats import pct_rank
from ..sources.scratch import cut


def top_n(df: DataFrame, by: str, n: int, part=("date",), tie: str = "ticker",
          ascending: bool = False) -> DataFrame:
    """Best n per group with their rank.

    row_number() <= n lets Spark keep only n rows per group and input partition
    before the shuffle (WindowGroupLimit), so a huge group costs one pass.
    """
    order = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    rn = F.row_number().over(W.partitionBy(*part).orderBy(order, F.col(tie)))
    return df.where(F.col(by).isNotNull()).withColumn("rank", rn).where(F.col("rank") <= n)


def decile_signal(df: DataFrame, rank: str = "pct_rank", hi: float = 0.9, lo: float = 0.1) -> DataFrame:
    return df.withColumn(
        "decile_signal", F.when(F.col(rank) > hi, 1).when(F.col(rank) < lo, -1).otherwise(0)
    )


def composite_rank(df: DataFrame, weights: dict[str, float], n: int, part=("date",)) -> DataFrame:
    """Weighted sum of percentile ranks, best n per group. Every rank reads the input, so it is written once."""
    out = cut(df, "ranked")
    score = F.lit(0.0)
    for c, w in weights.items():
        out = pct_rank(out, c, part, f"rank_{c}")
        score = score + w * F.col(f"rank_{c}")
    return top_n(out.withColumn("composite", score), "composite", n, part)


def n_largest(df: DataFrame, col: str, n: int, tie: str = "ticker") -> DataFrame:
    """TakeOrderedAndProject: every task keeps its own n best."""
    return df.where(F.col(col).isNotNull()).orderBy(F.col(col).desc(), F.col(tie)).limit(n)


def top_long_short(signals: DataFrame, n_long: int, n_short: int, by: str = "position") -> DataFrame:
    longs = n_largest(signals.where(F.col(by) > 0), by, n_long).withColumn("side", F.lit("long"))
    shorts = (
        signals.where(F.col(by) < 0).orderBy(F.col(by), F.col("ticker")).limit(n_short)
        .withColumn("side", F.lit("short"))
    )
    return longs.unionByName(shorts)


def sector_capped_top_n(df: DataFrame, by: str, n: int, cap: int, part=("date",),
                        uncapped: str = "General") -> DataFrame:
    """Best n with at most `cap` names per sector.

    Equal to picking greedily: a name is skipped exactly when `cap` better
    names of its sector exist.
    """
    free = F.col("sector") == uncapped
    capped = top_n(df.where(~free), by, cap, (*part, "sector")).drop("rank")
    return top_n(capped.unionByName(df.where(free)), by, n, part)


def with_slot(selection: DataFrame, held: DataFrame, order: str = "rank") -> DataFrame:
    """Display order: kept names first in rank order, then the new ones."""
    kept = selection.join(held.select("ticker", F.lit(True).alias("_h")), "ticker", "left").withColumn(
        "kept", F.coalesce("_h", F.lit(False))
    ).drop("_h")
    w = W.partitionBy("date").orderBy(F.col("kept").desc(), F.col(order), F.col("ticker"))
    return kept.withColumn("slot", F.row_number().over(w))


def best_config(results: DataFrame, metric: str, keys=(), tie: str = "config_id") -> DataFrame:
    """Row of the best metric; metrics equal to nine places tie, the lowest id wins."""
    rest = [c for c in results.columns if c not in keys]
    best = results.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.round(metric, 9), -F.col(tie))).alias("_b")
    )
    return best.select(*keys, "_b.*")


def latest_n(trades: DataFrame, n: int, order=("ts",)) -> DataFrame:
    return trades.orderBy(*[F.col(c).desc() for c in order]).limit(n)
