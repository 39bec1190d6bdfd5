"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tickloom.plans import registry
from tickloom.session import build_session

HEADLINE = (
    "event_bars", "rolling_indicators", "recursive_indicators", "condition_counts", "signal_screen", "hour_profile",
    "level_entries", "trade_outcomes", "level_matrix", "naive_baseline", "window_scan", "named_setups",
    "trade_stats", "bootstrap_report", "volatility_regimes", "structural_breaks", "split_proposals",
    "swap_drag", "session_windows", "registry_differences", "survivor_distribution", "price_quantiles",
    "block_differences", "workflow_findings", "ingest_blocks",
    "recursive_indicators_blocks", "signal_screen_blocks", "level_matrix_blocks",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the executor before timing
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
