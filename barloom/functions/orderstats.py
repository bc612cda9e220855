"""Exact ranks and quantiles that never put a whole group into one task.

A cross-section (all tickers of one date) or a whole training column may hold
any share of the table. The helpers here cut each group into value ranges:

1. distinct values with their counts (a partial aggregate, so ties collapse);
2. per group, the values with the smallest hashes give range borders. The
   borders depend on the data only, so a recomputed task sees the same ones.
   They steer the layout and never the result, any borders give exact ranks;
3. counts per range give each range its offset, and ranks are counted inside
   the ranges only.

The ranged values are written once to the shared folder, because offsets and
ranks both read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import cut

_STEPS = (128, 64, 32, 16, 8, 4, 2, 1)
RANGES = 240
# Sample of the borders: the smallest hashes of each of SHARES shares of a group.
# The per-share limit is pushed below the shuffle (WindowGroupLimit), and the
# shares spread the sample of one huge group over SHARES tasks.
SHARES, PER_SHARE = 64, 15


def _locate(borders: Column, v: Column) -> Column:
    """Number of borders strictly below v, by binary search in the array."""
    return F.aggregate(
        F.array(*[F.lit(s) for s in _STEPS]),
        F.lit(0),
        lambda pos, step: pos
        + F.when(F.get(borders, pos + step - 1) < v, step).otherwise(F.lit(0)),
    )


def _ranged_values(df: DataFrame, keys: list[str], col: str, by: tuple[str, ...] = ()) -> DataFrame:
    """keys, by, v, cnt, rng: distinct values with counts and their value range.

    The ranges belong to the keys; `by` only splits the counts further.
    """
    v = F.col(col).cast("double")
    values = (
        df.where(v.isNotNull())
        .groupBy(*keys, *by, v.alias("v"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    picks = (
        (values.select(*keys, "v").distinct() if by else values)
        .withColumn("h", F.xxhash64("v", *keys))
        .withColumn("share", F.pmod(F.xxhash64("h"), F.lit(SHARES)))
        .withColumn("pick", F.row_number().over(W.partitionBy(*keys, "share").orderBy("h", "v")))
        .where(F.col("pick") <= PER_SHARE)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("v")).alias("s"))
        .select(
            *keys,
            F.expr(
                f"transform(sequence(1, {RANGES - 1}), i -> "
                f"element_at(s, cast(greatest(1, ceil(i * size(s) / {RANGES}.0D)) as int)))"
            ).alias("borders"),
        )
    )
    ranged = values.join(picks, keys).select(
        *keys, *by, "v", "cnt", _locate(F.col("borders"), F.col("v")).alias("rng")
    )
    return cut(ranged, "ranges")


def _with_offsets(vals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rng, before, inside, total: at most RANGES rows per group."""
    w = W.partitionBy(*keys).orderBy("rng")
    return (
        vals.groupBy(*keys, "rng")
        .agg(F.sum("cnt").alias("inside"))
        .select(
            *keys,
            "rng",
            "inside",
            (F.sum("inside").over(w) - F.col("inside")).alias("before"),
            F.sum("inside").over(W.partitionBy(*keys)).alias("total"),
        )
    )


def _keyed(df: DataFrame, keys) -> tuple[DataFrame, list[str]]:
    keys = list(keys)
    return (df, keys) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def value_ranks(df: DataFrame, keys, col: str) -> DataFrame:
    """keys, v, first_rank, ties, total: exact rank of every distinct value."""
    df, keys = _keyed(df, keys)
    vals = _ranged_values(df, keys, col)
    offs = _with_offsets(vals, keys)
    w = W.partitionBy(*keys, "rng").orderBy("v")
    return vals.join(offs, [*keys, "rng"]).select(
        *keys,
        "v",
        (F.col("before") + F.sum("cnt").over(w) - F.col("cnt") + 1).alias("first_rank"),
        F.col("cnt").alias("ties"),
        "total",
    )


def pct_rank(df: DataFrame, col: str, part=("date",), out: str = "pct_rank") -> DataFrame:
    """Average-tie percentile rank: mean rank of the ties / group size."""
    work, keys = _keyed(df, part)
    ranks = value_ranks(work, keys, col).select(
        *keys,
        F.col("v").alias("_v"),
        ((F.col("first_rank") + (F.col("ties") - 1) / 2.0) / F.col("total")).alias(out),
    )
    joined = work.withColumn("_v", F.col(col).cast("double")).join(ranks, [*keys, "_v"], "left")
    return joined.drop("_v", "_all")


def quantiles(df: DataFrame, keys, col: str, qs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group; one column per name in qs.

    Only the value ranges that hold a wanted position are ranked.
    """
    had_keys = bool(list(keys))
    df, keys = _keyed(df, keys)
    vals = _ranged_values(df, keys, col)
    offs = _with_offsets(vals, keys)
    wanted = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q"))
            for n, q in qs.items()
        ]
    )
    pos = F.col("w.q") * (F.col("total") - 1)
    spots = (
        offs.select(*keys, "rng", "before", "inside", "total", F.explode(wanted).alias("w"))
        .select(
            *keys, "rng", "before", "inside", F.col("w.name").alias("name"),
            F.floor(pos).alias("lo"), F.ceil(pos).alias("hi"),
            (pos - F.floor(pos)).alias("frac"),
        )
        .where(
            (F.col("hi") >= F.col("before")) & (F.col("lo") < F.col("before") + F.col("inside"))
        )
    )
    hit = spots.select(*keys, "rng", "before").distinct()
    w = W.partitionBy(*keys, "rng").orderBy("v")
    ranked = vals.join(hit, [*keys, "rng"]).select(
        *keys, "rng", "v",
        (F.col("before") + F.sum("cnt").over(w) - F.col("cnt")).alias("first"),
        (F.col("before") + F.sum("cnt").over(w) - 1).alias("last"),
    )
    both = spots.drop("before", "inside").join(ranked, [*keys, "rng"])
    at = lambda p: F.max(F.when(F.col(p).between(F.col("first"), F.col("last")), F.col("v")))
    one = both.groupBy(*keys, "name", "frac").agg(at("lo").alias("a"), at("hi").alias("b"))
    val = F.col("a") + F.col("frac") * (F.col("b") - F.col("a"))
    out = one.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == n, val)).alias(n) for n in qs]
    )
    return out if had_keys else out.drop("_all")


def expanding_quantile(df: DataFrame, keys, date: str, cutoffs: Column, col: str, q: float, out: str) -> DataFrame:
    """keys, cutoff, out: exact quantile of all rows dated before each cut-off.

    Counts per (date, range) are spread over the later cut-offs; those are at
    most ranges x dates x dates rows, whatever the data size. They name the one
    range that holds the wanted position, and only values of that range meet
    the cut-offs themselves.
    """
    keys = list(keys)
    vals = _ranged_values(df, keys, col, (date,))
    per = vals.groupBy(*keys, date, "rng").agg(F.sum("cnt").alias("cnt")).withColumn("_cuts", cutoffs)
    later = per.withColumn("cutoff", F.explode(F.filter("_cuts", lambda c: c > F.col(date))))
    counts = later.groupBy(*keys, "cutoff", "rng").agg(F.sum("cnt").alias("inside"))
    group = [*keys, "cutoff"]
    w = W.partitionBy(*group).orderBy("rng")
    pos = F.lit(float(q)) * (F.col("total") - 1)
    spots = (
        counts.withColumn("before", F.sum("inside").over(w) - F.col("inside"))
        .withColumn("total", F.sum("inside").over(W.partitionBy(*group)))
        .withColumn("lo", F.floor(pos)).withColumn("hi", F.ceil(pos)).withColumn("frac", pos - F.floor(pos))
        .where((F.col("hi") >= F.col("before")) & (F.col("lo") < F.col("before") + F.col("inside")))
        .select(*group, "rng", "before", "lo", "hi", "frac")
    )
    hit = vals.join(spots, [*keys, "rng"]).where(F.col(date) < F.col("cutoff"))
    hit = hit.groupBy(*group, "rng", "before", "lo", "hi", "frac", "v").agg(F.sum("cnt").alias("cnt"))
    r = W.partitionBy(*group, "rng").orderBy("v")
    hit = hit.withColumn("last", F.col("before") + F.sum("cnt").over(r) - 1).withColumn("first", F.col("last") - F.col("cnt") + 1)
    at = lambda p: F.max(F.when(F.col(p).between(F.col("first"), F.col("last")), F.col("v")))
    one = hit.groupBy(*group, "frac").agg(at("lo").alias("a"), at("hi").alias("b"))
    return one.select(*group, (F.col("a") + F.col("frac") * (F.col("b") - F.col("a"))).alias(out))
