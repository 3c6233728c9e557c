"""Times the headline queries over $BENCH_SF_DIR and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from panelforge.plans import registry
from panelforge.session import session

HEADLINES = ["bars_ohlcv", "z_momentum_x_low_roll_impact", "vpin", "combined_risk_tercile", "ic_by_time", "ridge_select", "market_stress", "policy_grid", "asof_prior", "backtest_summary"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["bars_ohlcv"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINES:
        began = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
