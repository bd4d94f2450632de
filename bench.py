"""Time the headline queries. Env: BENCH_SF_DIR, BENCH_CPUS. Prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from panelfolio.queries import REGISTRY
from panelfolio.session import build_session

HEADLINE = ["adjusted_prices", "limit_flags", "filled_panel", "blended_momentum", "rolling_ols", "regimes", "backtest_ladder",
            "backtest_limits", "robust", "capm", "multi_strategy_report", "walk_forward", "selection_margin", "basket_methods",
            "pair_perf", "orders_cash_cap", "ledger", "fill_stream"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    small = "/root/testdata/sf0.001"
    if os.path.isdir(small):
        REGISTRY["backtest_ladder"](spark, small).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
