"""Resampled paths of return series, worked in arrays.

A returns table is (portfolio, date, ret). A series is one array, bounded by the
calendar; it goes with a range of simulations to a task, which draws, compounds and
reduces them as matrices of at most TASK_VALUES numbers (or one path). One row per
path leaves the task: no exchange has more rows than portfolios x simulations, and a
single portfolio with thousands of paths fills the cluster. Draws are functions of
(seed, simulation, row), so a retried task makes the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import lcg_array, normal_array
from ..sources.scratch import cut

P = "portfolio"

# Noise deviation, crash size and length, block lengths.
NOISE_SIGMA = 0.005
CRASH_DROP, CRASH_DAYS = 0.10, 5
BLOCK_DAYS = 63
BLOCK_MIN, BLOCK_MAX = 3, 6

#: Numbers of one matrix of paths.
TASK_VALUES = 500_000

#: (returns, simulation numbers) to a matrix, one path a row.
Draw = Callable[[np.ndarray, np.ndarray], np.ndarray]


def noise(sigma: float = NOISE_SIGMA, seed: int = 42) -> Draw:
    """Every return with normal noise."""
    return lambda ret, sims: ret + sigma * normal_array(sims[:, None], np.arange(len(ret)), seed=seed)


def shuffle(seed: int = 42) -> Draw:
    """All returns in random order."""
    return lambda ret, sims: ret[np.argsort(lcg_array(sims[:, None], np.arange(len(ret)), seed=seed), axis=1, kind="stable")]


def crash(seed: int = 42) -> Draw:
    """A fall on CRASH_DAYS days from a random one."""

    def draw(ret, sims):
        start = lcg_array(sims, seed=seed) % max(1, len(ret) - CRASH_DAYS)
        day = np.arange(len(ret)) - start[:, None]
        return np.where((day >= 0) & (day < CRASH_DAYS), ret - CRASH_DROP, ret)

    return draw


def blocks(block: int = BLOCK_DAYS, seed: int = 42) -> Draw:
    """Blocks of fixed length from random starts, cut to the length of the series."""

    def draw(ret, sims):
        pos = np.arange(len(ret))
        start = lcg_array(sims[:, None], np.arange(-(-len(ret) // block)), seed=seed) % max(1, len(ret) - block)
        return ret[start[:, pos // block] + pos % block]

    return draw


def variable_blocks(lo: int = BLOCK_MIN, hi: int = BLOCK_MAX, seed: int = 42) -> Draw:
    """Blocks of lo..hi rows one behind the other."""

    def draw(ret, sims):
        n, b = len(ret), np.arange(-(-len(ret) // lo) + 1)
        size = lo + lcg_array(sims[:, None], b, seed=seed) % (hi - lo + 1)
        start = lcg_array(sims[:, None], b, seed=seed + 7) % np.maximum(1, n - size)
        offset = np.cumsum(size, axis=1) - size
        # Row r of a path lies in the last block whose offset is not behind r.
        row = np.zeros((len(sims), n), np.int64)
        s, k = np.nonzero((offset > 0) & (offset < n))
        row[s, offset[s, k]] = 1
        which = np.cumsum(row, axis=1)
        take = lambda x: np.take_along_axis(x, which, axis=1)
        return ret[take(start) + np.arange(n) - take(offset)]

    return draw


def digest(path: np.ndarray) -> list[np.ndarray]:
    """Length, sum of returns, sum weighted by place."""
    return [np.full(len(path), float(path.shape[1])), path.sum(axis=1), path @ np.arange(path.shape[1], dtype=float)]


def measures(path: np.ndarray, ann: int = 252) -> list[np.ndarray]:
    """Final value, CAGR (-1 after a loss of all), deepest fall, Sharpe (NaN without spread) of every path."""
    growth = np.cumprod(1 + path, axis=1)
    final, n = growth[:, -1], path.shape[1]
    with np.errstate(all="ignore"):
        cagr = np.where(final > 0, np.power(np.maximum(final, 0), ann / n) - 1, -1.0)
        fall = (growth / np.maximum.accumulate(growth, axis=1)).min(axis=1) - 1
        sd = path.std(axis=1, ddof=1) if n > 1 else np.full(len(path), np.nan)
        sharpe = np.where(sd > 0, path.mean(axis=1) * np.sqrt(ann) / sd, np.nan)
    return [final, cagr, fall, sharpe]


def series(returns: DataFrame) -> DataFrame:
    """portfolio and its returns in order of date, as one array."""
    rows = returns.where(F.col("ret").isNotNull()).groupBy(P).agg(F.array_sort(F.collect_list(F.struct("date", "ret"))).alias("rows"))
    return rows.select(P, F.transform("rows", lambda r: r["ret"]).alias("rets"))


def resample(returns: DataFrame, n_sim: int, draw: Draw, reduce: Callable[[np.ndarray], list[np.ndarray]], names: tuple[str, ...]) -> DataFrame:
    """One row per portfolio and simulation: portfolio, sim and what reduce makes of the path (NaN becomes null)."""
    found = cut(series(returns), "series")
    step = F.greatest(F.lit(1), F.floor(F.lit(TASK_VALUES) / F.size("rets")).cast("int"))
    ranges = found.select(P, "rets", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(n_sim - 1), step)).alias("lo"))
    ranges = ranges.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), P, "lo")
    schema = ", ".join([f"{P} {found.schema[P].dataType.simpleString()}", "sim long", *[f"{c} double" for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lo, step = batch.column(3)[i].as_py(), batch.column(2)[i].as_py()
                sims = np.arange(lo, min(lo + step, n_sim), dtype=np.int64)
                values = reduce(draw(batch.column(1)[i].values.to_numpy(), sims))
                who = batch.column(0).take(pa.array(np.full(len(sims), i)))
                yield pa.RecordBatch.from_arrays([who, pa.array(sims), *[pa.array(v, from_pandas=True) for v in values]], names=[P, "sim", *names])

    return ranges.mapInArrow(run, schema)


def path_digest(returns: DataFrame, n_sim: int, draw: Draw) -> DataFrame:
    return resample(returns, n_sim, draw, digest, ("n", "total", "placed")).withColumn("n", F.col("n").cast("long"))


def path_measures(returns: DataFrame, n_sim: int, draw: Draw) -> DataFrame:
    return resample(returns, n_sim, draw, measures, ("final", "cagr", "max_drawdown", "sharpe"))
