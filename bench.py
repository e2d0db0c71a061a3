"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local threads. Every query runs over its whole tables into a
sink that discards rows; the session is warmed up on one query first. ``search`` is the period search with its own
configuration beside it: one source of as many samples as the published run, a stretch of its period grid.
"""

from __future__ import annotations

import json
import os
import sys
import time

import numpy as np
from pyspark.sql import SparkSession

from foldspark import queries as library
from foldspark.config import SearchConfig
from foldspark.operators import search

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = (
    "detrend_fold_bin", "rolling_median_trend", "rolling_median_masked", "robust_spline_trend", "global_view", "contamination", "split_manifest", "bias_table",
    "select_products", "fill_missing", "bls_search", "processed_curves", "examples",
)
SAMPLES, DAYS, PERIODS = 51_747, 1459.0, 24_197


def period_search(spark: SparkSession) -> dict:
    """Seconds for PERIODS periods of one source on all cores, and the same per 1,000 periods."""
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(0, DAYS, SAMPLES))
    y = 1 + rng.normal(0, 1e-4, SAMPLES)
    curve = spark.createDataFrame(list(zip([1] * SAMPLES, t.tolist(), y.tolist(), [1e-4] * SAMPLES)), "kepid long, time double, flux double, flux_err double")
    lo = 1.0
    step = (1.0 / 24) / (3.0 * (t[-1] - t[0]))
    config = SearchConfig(min_period_days=lo, max_period_days=float(lo * np.exp(step * (PERIODS - 1))), chunk=1024)
    start = time.time()
    found = search.periodogram(search.search_inputs(curve, ["kepid"], config), ["kepid"], config)
    n = search.best_peaks(found, ["kepid"]).first()["n_periods"]
    seconds = time.time() - start
    return {"seconds": round(seconds, 2), "samples": SAMPLES, "periods": n, "durations": len(config.durations_hours), "cores": CPUS, "seconds_per_1000_periods": round(1000 * seconds / n, 4)}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", str(max(8, CPUS))).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made = library.queries()
    made["clean_stats"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        made[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    found = period_search(spark)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")), "cores": CPUS, "search": found}))


if __name__ == "__main__":
    main()
