"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of cores. Each query runs once to warm up
and three times for its median; results go to a no-op sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from duskboard.plans.registry import queries  # noqa: E402
from duskboard.session import local_session  # noqa: E402

HEADLINE = [
    "day_agenda", "all_pages", "film_day", "agenda_as_of", "upsert_events", "match_event_keys", "validate_batch",
    "field_coverage", "film_groups", "list_events", "dedupe_keep_first", "localize_content", "normalize_price",
    "parse_date_phrase", "clean_text", "strip_html", "extract_jsonld_events", "reconstruct_lines", "schedule_segments",
    "session_production_join",
]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    registered = queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for run in range(RUNS + 1):
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
