"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from barloom.plans.catalog import CATALOG
from barloom.session import local_session

HEADLINE = ["bars_source", "top_ranked", "rsi", "macd", "directional_index", "bollinger_bands", "all_indicators", "feature_matrix",
            "triple_barrier_label", "fold_assignment", "universe_scan", "trade_outcomes", "daily_options_summary", "black_scholes",
            "news_sentiment", "candles", "performance_summary", "trade_verdicts"]
LONG = 10  # seconds from which on a query is run once; others take the median of three


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    CATALOG["bars_source"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the session
    seconds = {}
    for name in HEADLINE:
        runs: list[float] = []
        while len(runs) < 3 and (not runs or runs[0] < LONG):
            start = time.time()
            CATALOG[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(median(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
