"""Headline timings: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set below).
Each query's plan is executed in full with the ``noop`` sink (nothing is
collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "max_ndvi_composite",       # flagship: period + polygon mask + NDVI + max composite
    "spectral_indices",
    "band_assembly",
    "focal_median",
    "pyramid",
    "regrid_bilinear",
    "reproject_web_mercator",
    "jenks_breaks",
    "kmeans_pixels",
    "catalog_area_time_query",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    from dunegrid.session import get_spark
    from dunegrid.plans import QUERIES

    spark = get_spark(f"local[{cpus}]", app="dunegrid-bench", shuffle_partitions=max(8, 2 * cpus))
    # warm-up on the smallest table set so JIT and Python workers are not timed
    small = "/root/testdata/sf0.001"
    if os.path.isdir(small):
        for name in ("max_ndvi_composite", "focal_median"):  # JVM paths and the Python worker pool
            QUERIES[name].fn(spark, small).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        df = QUERIES[name].fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
