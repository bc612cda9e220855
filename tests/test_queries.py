"""Catalog queries against DuckDB on the smallest tables.

A cross-section by default; BARLOOM_ALL=1 runs every query that has SQL.
"""

import collections
import os

import duckdb
import pytest

from barloom import catalog
from tools.check import TABLES, norm

QUERIES, ORACLES = catalog.load()
SOME = ["src01", "src10", "ing04", "ing11", "ing16", "ing21", "fil05", "gate01", "gate04", "cal04", "cal08", "ind02", "ind13", "ind18", "ind23",
        "reg05", "jn05", "jn06", "jn08", "set02", "agg02", "agg10", "rnk02", "rnk07", "fac03", "fac08", "pos01", "pos07", "pos08", "prt01", "prt06", "prt11",
        "att03", "att07", "met04", "met09", "led02", "led06", "led12", "led13", "drv03", "drv14", "rob02", "rob05", "rob07", "rob11", "ml03", "ml07", "ml17", "st01", "st06"]
NAMES = sorted(n for n in ORACLES if os.environ.get("BARLOOM_ALL") or n.split("_")[0] in SOME)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLES[name])
    have = [c[0] for c in cur.description]
    assert sorted(have) == cols
    order = [have.index(c) for c in cols]
    want = collections.Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    got = collections.Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    assert got == want
