"""Times the registered queries and prints one line of JSON.

Reads the tables in $BENCH_SF_DIR on local[$BENCH_CPUS]. Each query is built and run in full,
with its result sent to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import time

from testbed.compare import session
from testbed.queries import queries

# The result tables of a run, and the joins that lead to them.
HEADLINE = (
    "access_log_parse",
    "runtime_log_parse",
    "hits_links",
    "runtime_enriched",
    "oid_values_joined",
    "enriched_log",
    "enriched_roundtrip",
    "bounce_rate",
    "entrance_rate",
    "average_visits",
    "page_flow",
    "next_navigation",
    "residence_time",
    "output_link",
    "input_link",
    "top10_displayed",
    "top10_clicked",
    "combined_analysis",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    # The first query of a session pays for starting it.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").count().write.format("noop").mode(
        "overwrite"
    ).save()
    registered = queries()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "wall time of all headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
