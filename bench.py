"""Time the workload queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated, default all), BENCH_RUNS (default 1).
"""

from __future__ import annotations

import json
import os
import sys
import time

from fileledger.session import local_session
from workload.queries import queries


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n]
    spark = local_session(cpus, "fileledger-bench")
    # Session start-up and the first compilation are not part of any query.
    spark.read.parquet(f"{folder}/orders.parquet").selectExpr("count(*)", "max(md5(o_orderstatus))").collect()
    timings: dict[str, float] = {}
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        best = None
        for _ in range(runs):
            started = time.perf_counter()
            # Every row and column is computed; nothing travels to the driver.
            query(spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        timings[name] = round(best, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "workload_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder).removeprefix("sf"), "cpus": cpus,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
