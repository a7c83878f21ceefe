"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores; BENCH_QUERIES may name
other catalog queries, separated by commas, or be `all`.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from loomstats.plans import catalog
from loomstats.settings import build_session

HEADLINE = [
    "q_model_language", "q_daily_stats", "q_anomaly_accepts", "q_velocity", "q_threads", "q_episodes", "q_steps_pauses",
    "q_log_daily", "q_log_by_session", "q_latency_percentiles", "q_grouping_sets_counts", "q_usage_by_model",
    "q_usage_checkpoint", "q_project_rollup", "q_keywords", "q_permissions", "q_fusion_paths", "q_prompt_buckets",
    "q_title_match_nearest", "q_stream_daily_rollup",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    queries = catalog.queries()
    names = list(queries) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
