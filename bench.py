"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from usagelake.plans import registry
from usagelake.session import build_session

HEADLINE = (
    "w1_counter_deltas",
    "a12_turns_vs_session",
    "a3_message_session_usage",
    "a4_message_turns",
    "t2_top_expensive_turns",
    "p6_tool_call_linking",
    "p9_turn_assignment",
    "a10_fresh_coverage",
    "a14_coverage_source",
    "a15_nearest_rank",
    "r2_repeated_calls",
    "a16_turn_cost",
    "a17_session_cost",
    "a18_cost_rollup",
    "j4_mutual_best_match",
    "a13_reconciliation_summary",
    "a21_profile_account",
    "g6_request_report",
    "g1_chain_members",
    "g5_chain_report",
    "st1_stream_usage",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    only = sys.argv[1:]
    seconds: dict[str, float] = {}
    # One small query first, so that starting the JVM is not part of a figure.
    registry.QUERIES["x9_provider_model_split"](spark, sf_dir).collect()
    for name in only or HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
