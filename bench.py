"""Warm times of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON.

A query is built and run whole each time, its rows sent to a sink that drops
them; the figure is the median of the runs after the first.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from stratakit.plans import registry
from stratakit.session import get_spark

QUERIES = (
    "search_hybrid", "search_knn_top", "search_bm25_top", "graph_second_hop", "graph_cheapest_paths", "rules_closure", "dup_shingle_pairs", "session_gaps",
    "rel_pricing_summary", "rel_shipping_priority", "rel_local_supplier_volume", "rel_forecast_revenue",
)
RUNS = int(os.environ.get("BENCH_RUNS", "4"))


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = get_spark(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "7g"))
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in QUERIES:
        runs = []
        for _ in range(RUNS):
            began = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:] or runs), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "warm_seconds_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(Path(folder).name.removeprefix("sf"))}))


if __name__ == "__main__":
    main()
