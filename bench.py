"""Time the headline queries: one JSON line with seconds per query.

Each query runs once to warm the JVM and is then timed; the result goes to the no-op sink,
so every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnwise.plans.catalog import RUNS  # noqa: E402
from turnwise.session import local_session  # noqa: E402

HEADLINE = [
    "pair_turns",
    "search_pairs",
    "retrieve_topics",
    "keyword_hits",
    "typed_scores",
    "ground_quotes",
    "contradiction_sides",
    "fit_impute_refs",
    "session_totals",
    "fit_calibrator_mae",
    "paired_bootstrap",
    "paired_permutation",
    "error_cells",
    "transfer_gate",
    "near_duplicates",
    "event_violations",
    "stream_pairs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=cores)
    seconds = {}
    for name in names:
        times = []
        for i in range(repeats + 1):
            start = time.perf_counter()
            RUNS[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(sorted(times[1:])[(len(times) - 1) // 2], 3)
        print(f"{name}: {seconds[name]} (first {times[0]:.2f})", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(folder.rstrip("/")).replace("sf", "") or 0),
            }
        )
    )


if __name__ == "__main__":
    main()
