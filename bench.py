"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores. Every query runs to its last row into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from hostgauge.queries import QUERIES
from hostgauge.session import build_session

HEADLINE = [
    "alerts", "event_features", "rolling_features", "trailing_counts", "args_features", "frequency_tables",
    "scaler_statistics", "entity_thresholds", "supplier_price_thresholds", "severity_by_entity", "ranking",
    "threshold_sweep", "test_report", "user_states", "score_drift", "probe_json_ingest", "auditd_ingest",
    "envelope_decode", "document_text_flags", "tiny_forest_score", "fitted_forest_scores", "live_grades",
    "stream_rolling_features", "stream_alerts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "hostgauge-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    QUERIES["known_hosts"](spark, sf_dir).count()  # starts executor threads
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
