"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (best of, default 2; the first run
of a query pays for code generation and Python worker start).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dictalog.plans import QUERIES  # noqa: E402
from dictalog.session import build_session  # noqa: E402

HEADLINE = [
    "o2_page_drafts",
    "j1_with_parent",
    "j3_draft_family",
    "j4_validate_ids",
    "j6_merge_vad",
    "j7_lookback",
    "j11_pair_rescans",
    "w1_ring_buffer",
    "w4_speech_segments",
    "w8_draft_spans",
    "a8_best_match_per_pattern",
    "x6_all_matches",
    "s1_read_event_log",
    "s14_fan_out",
    "s15_feed_table",
    "t1_draft_builder_batch",
    "t1_draft_builder_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(min(times), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
