"""``python -m millrace DIR [QUERY...]``: run queries by name over the tables in DIR.

Without names, reads them from standard input, one a line up to an empty one or ``stop``. Results go to
result1.csv, result2.csv, ... in the working folder and to standard output; the time that each query took to plan and to run
goes to standard error, with --trace also the rows and times of its operators.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame

from .plans import QUERIES, STANDARD_QUERIES
from .session import session
from .sources import load_tables, run_batch
from .trace import report


def main() -> None:
    parser = argparse.ArgumentParser(prog="millrace", description="Run decision-support queries over Parquet tables.")
    parser.add_argument("dir", help="folder (or any URI Spark reads) with <table>.parquet")
    parser.add_argument("queries", nargs="*", help="q1 ... q22, or 1 ... 22")
    parser.add_argument("--master", help="Spark master, such as local[8]; a cluster's launcher sets its own")
    parser.add_argument("--standard", action="store_true", help="the literals of the published workload")
    parser.add_argument("--trace", action="store_true", help="rows and times of each operator")
    parser.add_argument("--distributed", metavar="URI", help="write each result as a folder below URI, by Spark's tasks, for large results")
    own = parser.parse_args()
    queries = STANDARD_QUERIES if own.standard else QUERIES
    names = own.queries
    if not names:
        for line in sys.stdin:
            if line.strip() in ("", "stop"):
                break
            names.append(line.split()[0])
    spark = session(own.master)
    spark.sparkContext.setLogLevel("ERROR")

    def ran(name: str, df: DataFrame, planning: float, running: float) -> None:
        print(f"{name}: planned in {planning * 1000:.0f} ms, ran in {running * 1000:.0f} ms", file=sys.stderr)
        if own.trace and not own.distributed:
            print(report(df), end="", file=sys.stderr)

    began = time.perf_counter()
    found = load_tables(spark, own.dir).load()
    print(f"load: {len(found)} tables in {(time.perf_counter() - began) * 1000:.0f} ms", file=sys.stderr)
    run_batch(spark, own.dir, names, queries, folder=own.distributed or ".", distributed=bool(own.distributed), ran=ran)
    print(f"all: {(time.perf_counter() - began) * 1000:.0f} ms", file=sys.stderr)
    spark.stop()


if __name__ == "__main__":
    main()
