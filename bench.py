"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query first runs at a tenth of the scale, if that folder lies beside the
other one: this warms the code up and shows how the time grows with the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "ind04_sma", "ind05_realized_vol", "ind12_risk_adjusted_momentum", "ind21_contraction", "reg05_hysteresis",
    "ing04_validate_sequential", "ing08_merge_bars", "jn05_asof_join", "jn06_range_join", "rnk01_top_n",
    "rnk02_pct_rank", "agg03_quantiles", "prt06_cap_weights", "att03_period_daily_returns", "fac01_market_beta",
    "fac04_robust_z", "led02_average_cost", "led06_daily_snapshots", "drv11_price_spread", "rob04_block_bootstrap",
    "rob10_factorial_blind_test", "met09_capm", "ml01_feature_matrix",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from barloom import catalog
    from barloom.sources.scratch import ensure_local_root

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_local_root(spark)
    queries, _ = catalog.load()
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    root, sf = SF_DIR.rstrip("/").rsplit("sf", 1)
    small = f"{root}sf{float(sf) / 10:g}"

    def timed(name: str, folder: str) -> float:
        t0 = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.time() - t0, 3)

    times, before = {}, {}
    for name in HEADLINE:
        if os.path.isdir(small):
            before[name] = timed(name, small)
        times[name] = timed(name, SF_DIR)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "queries_at_a_tenth": before}))


if __name__ == "__main__":
    main()
