"""Resampled paths on series of odd lengths, against plain loops."""

import math

import pytest

from barloom.functions.draws import lcg_array
from barloom.operators import resampling as R
from barloom.operators.robustness import path_summary


@pytest.fixture(scope="module")
def returns(spark):
    rows = [("one", "2024-01-01", 0.5)] + [("ruin", f"2024-01-{d:02d}", -1.0 if d == 5 else 0.01) for d in range(1, 10)]
    rows += [("long", f"{2000 + i // 360}-{i % 360 // 30 + 1:02d}-{i % 30 % 28 + 1:02d}", (i % 7 - 3) / 100) for i in range(200)] + [("none", "2024-01-01", None)]
    return spark.createDataFrame(rows, "portfolio string, date string, ret double").repartition(3)


@pytest.mark.parametrize("draw", [R.noise(), R.shuffle(), R.crash(), R.blocks(), R.variable_blocks()])
def test_every_path_has_the_length_of_its_series(returns, draw):
    rows = R.path_digest(returns, 7, draw).collect()
    assert sorted({(r.portfolio, r.n) for r in rows}) == [("long", 200), ("one", 1), ("ruin", 9)]
    assert sorted(r.sim for r in rows if r.portfolio == "long") == list(range(7))


def test_variable_blocks_are_laid_one_behind_the_other(spark, returns):
    ret = [r.ret for r in returns.where("portfolio = 'long'").orderBy("date").collect()]
    got = {r.sim: r.placed for r in R.path_digest(returns.where("portfolio = 'long'"), 20, R.variable_blocks()).collect()}
    for sim in range(20):
        path, b = [], 0
        while len(path) < len(ret):
            size = 3 + int(lcg_array(sim, b)) % 4
            start = int(lcg_array(sim, b, seed=49)) % max(1, len(ret) - size)
            path, b = path + ret[start:start + size], b + 1
        assert math.isclose(got[sim], sum(i * x for i, x in enumerate(path[:len(ret)])), abs_tol=1e-9)


def test_loss_of_all_and_no_spread(returns):
    rows = {r.portfolio: r for r in R.path_measures(returns, 1, R.shuffle()).collect()}
    assert rows["ruin"].final == 0 and rows["ruin"].cagr == -1 and rows["ruin"].max_drawdown == -1
    assert rows["one"].sharpe is None and math.isclose(rows["one"].cagr, 1.5 ** 252 - 1)
    found = {r.portfolio: r for r in path_summary(R.path_measures(returns, 50, R.blocks())).collect()}
    assert found["ruin"].ruin_prob == 1 and found["ruin"].passed is False and found["long"].sims == 50


def test_ranges_of_simulations_do_not_change_a_path(returns, monkeypatch):
    near = lambda df: sorted((r.portfolio, r.sim, r.n, round(r.total, 9), round(r.placed, 9)) for r in df.collect())
    whole = near(R.path_digest(returns, 30, R.blocks()))
    monkeypatch.setattr(R, "TASK_VALUES", 1000)
    assert near(R.path_digest(returns, 30, R.blocks())) == whole
