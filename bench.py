"""Time the headline queries: one warm-up and the median of three full runs to the noop sink.

Prints one JSON line.  BENCH_SF_DIR chooses the tables, BENCH_CPUS the local cores,
BENCH_RUNS the number of timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tidemark.session import clear_scratch  # noqa: E402
from workload.registry import QUERIES  # noqa: E402

HEADLINE = [
    "quotes_series", "clean_prices", "fill_backward", "technicals_join", "naive_score",
    "learner_scores", "tune", "evaluate_best", "walk_forward_fit", "forecast_metrics",
    "config_scores", "best_by_market_model", "best_by_model", "rank_in_market",
    "rank_curve_pooled", "rank_curve_by_market", "hp_sensitivity", "error_histogram",
    "model_summary", "aligned_trace", "gold_metrics", "align_models", "stream_log_scores"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            clear_scratch(spark)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": float(sf.rsplit("sf", 1)[-1]),
                      "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
