"""Times the 22 queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: one warm-up and three runs each, the median.

Prints one line of JSON.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from millrace.plans import QUERIES
from millrace.session import session

RUNS = 3


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", app="bench", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name, query in QUERIES.items():
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            query(spark, path).collect()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 4)
    scale = re.search(r"sf([\d.]+)", path)
    print(json.dumps({"metric": "22 queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
