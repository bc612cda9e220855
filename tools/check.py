"""Run catalog queries and their SQL side by side and compare every value.

python tools/check.py [--sf DIR] [--only PREFIX[,PREFIX]] [--explain]
"""

from __future__ import annotations

import argparse
import collections
import datetime as dt
import importlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def session(cores="8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("check")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("--only", default="")
    p.add_argument("--modules", default="")
    p.add_argument("--explain", action="store_true")
    a = p.parse_args()
    if a.modules:
        from barloom.catalog import base
        for m in a.modules.split(","):
            importlib.import_module(f"barloom.catalog.{m}")
        qs, orc = base.QUERIES, base.ORACLES
    else:
        from barloom import catalog
        qs, orc = catalog.load()
    if a.only:
        qs = {k: v for k, v in qs.items() if k.startswith(tuple(a.only.split(",")))}
    spark = session()
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    bad = []
    for name, fn in qs.items():
        t0 = time.time()
        try:
            df = fn(spark, a.sf)
            if a.explain:
                df.explain("formatted")
            plan = df._jdf.queryExecution().executedPlan().toString()
            for bad_op in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
                if bad_op in plan:
                    print(f"PLAN {name} has {bad_op}")
            cols = sorted(df.columns)
            rows = df.select(*cols).collect()
            t1 = time.time()
            if name not in orc:
                print(f"ROWS {name} {len(rows)} rows {t1 - t0:.1f}s")
                if not rows:
                    bad.append(name)
                continue
            cur = con.execute(orc[name])
            ocols = [c[0] for c in cur.description]
            orows = cur.fetchall()
            t2 = time.time()
            if sorted(ocols) != cols:
                print(f"BAD  {name} columns {cols} vs {sorted(ocols)}")
                bad.append(name)
                continue
            order = [ocols.index(c) for c in cols]
            left = collections.Counter(tuple(norm(v) for v in r) for r in rows)
            right = collections.Counter(tuple(norm(r[i]) for i in order) for r in orows)
            if left == right and rows:
                print(f"OK   {name} {len(rows)} rows {t1 - t0:.1f}s oracle {t2 - t1:.1f}s")
            else:
                bad.append(name)
                l, r = list((left - right).items()), list((right - left).items())
                print(f"BAD  {name} spark {len(rows)} oracle {len(orows)} only-spark {len(l)} only-oracle {len(r)}")
                print("   cols ", cols)
                for x in sorted(l)[:3]:
                    print("   spark ", x)
                for x in sorted(r)[:3]:
                    print("   oracle", x)
        except Exception as e:  # report and go on with the next query
            bad.append(name)
            print(f"FAIL {name} {type(e).__name__} {str(e)[:900]}")
        sys.stdout.flush()
    print(f"{len(qs) - len(bad)} of {len(qs)} fine; bad: {bad}")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
