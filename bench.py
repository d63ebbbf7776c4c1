"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8).
Every column of every row is computed (noop sink). Each query runs twice; the second run counts, so
start-up and compilation of the JVM are left out. BENCH_QUERIES may name other queries (or "all").
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from thornwall.config import local_session
from thornwall.plans.queries import QUERIES

HEADLINE = [
    "injection_score",
    "pattern_score",
    "pattern_segments",
    "anomaly_score",
    "attack_overlap",
    "safety_score",
    "analyze_content",
    "html_visible_text",
    "html_extract",
    "sanitize_balanced",
    "sanitize_segments",
    "sanitize_rescore",
    "guard_audit",
    "guard_stats",
    "risk_summary",
    "report",
    "ocr_text",
    "embed_similarity",
    "normalize_text",
    "stream_analyze",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cores, shuffle_partitions=cores, spark__thornwall__testTasks=str(2 * cores))
    times = {}
    for name in names:
        for _ in range(2):
            begun = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - begun, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
