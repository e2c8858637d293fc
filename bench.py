"""Time the headline queries and print one JSON line.

Folder: $BENCH_SF_DIR (default /root/testdata/sf0.1); cores: $BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from doorstep import build_session  # noqa: E402
from doorstep.checks import load_all  # noqa: E402

HEADLINE = (
    "cohort_bands_small_cohorts", "cohort_bands_large_cohorts", "latest_observation",
    "lead_sheet", "sheet_order", "merged_duplicates", "upserted_businesses", "known_places",
    "first_sightings", "qualification", "rejected_types", "listing_scores", "offers_that_fire",
    "miss_ladder", "lookups_due", "cell_history", "selected_cells", "planned_cells",
    "website_verdicts", "site_grades", "best_handles", "named_contacts", "redacted_documents",
    "numbered_events", "snapshot_differences", "memory_recall", "call_costs",
    "stream_hourly_status_counts",
)


def run(spark, check, folder: str) -> float:
    start = time.perf_counter()
    check.run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "doorstep-bench",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    checks = load_all()
    run(spark, checks["latest_score"], folder)
    times = {}
    for name in names:
        times[name] = round(min(run(spark, checks[name], folder) for _ in range(rounds)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else None,
                "cores": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
