"""Times every registered query and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all cores),
BENCH_RUNS timed runs after one warm-up run (default 3), BENCH_QUERIES (comma list).
The time of a query is the median of its runs, from building the plan to the last row
of the result handed to a no-op sink. ``runs_of`` names the queries that were run less
often, because their runs would have taken longer than BENCH_LONG seconds (default 60).
"""

import json
import os
import re
import statistics
import time

from engagement.plans.registered import QUERIES
from engagement.session import local_session


def timed(query, spark, folder):
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    long = float(os.environ.get("BENCH_LONG", "60"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = local_session(cores, shuffle_partitions=cores)
    times, fewer = {}, {}
    for name in names:
        timed(QUERIES[name], spark, folder)
        taken = []
        while len(taken) < runs and sum(taken) < long:
            taken.append(timed(QUERIES[name], spark, folder))
        times[name] = round(statistics.median(taken), 3)
        if len(taken) < runs:
            fewer[name] = len(taken)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds_all_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
                "runs": runs,
                "runs_of": fewer,
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
