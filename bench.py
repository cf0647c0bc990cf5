"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelwright.queries import QUERIES
from panelwright.session import local_session

# Panel build, validation, scaling, the change scans (pooled, per region, per
# subject, three states), segmentation, policy learning, evaluation and reports.
HEADLINE = [
    "A-02", "B-02", "B-03", "B-11", "D-01", "D-07", "D-13", "D-15", "D-25", "D-30", "D-33", "D-36",
    "E-04", "G-01", "G-02", "G-03", "G-05", "G-08", "G-12", "G-13", "G-14",
    "K-03", "K-05", "Q-01", "Q-06", "Q-03", "P-05", "T-06", "C-12",
]
# Timed beside them; their sum is reported on its own, so that the headline stays comparable.
MORE = ["C-10", "G-07", "Q-02", "Q-09", "T-02", "T-03", "T-08", "A-05"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "panelwright-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's scan path and the Python workers before timing.
    QUERIES["G-13"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    def timed(keys):
        times = {}
        for key in keys:
            start = time.perf_counter()
            QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[key] = round(time.perf_counter() - start, 3)
        return times

    times, more = timed(HEADLINE), timed(MORE)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "more": more, "more_seconds": round(sum(more.values()), 3),
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
