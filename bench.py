"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from chainevents.plans.catalog import REGISTRY  # noqa: E402
from chainevents.session import local_session  # noqa: E402

HEADLINE = [
    "event_dedup", "event_append", "event_query", "event_page", "event_page_deep", "capped_query", "query_outcome",
    "scope_blocks", "bloom_prefilter", "log_match", "block_log_index", "present_ranges", "missing_ranges",
    "coverage_decision", "row_quality", "event_shape", "status_summary", "log_decode", "stored_event_query", "stored_event_page", "stored_totals",
    "query_rows", "log_decode_static", "stored_status", "stored_query_outcome", "stored_query_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    names = sys.argv[1:] or HEADLINE
    run = lambda name: REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("latest_block")  # starts the executors
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
