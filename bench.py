"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs from the Parquet files to its last row, twice; the second time counts. Nothing is shared between
queries: what a run persisted is dropped before the next.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from freshet.plans.workload import QUERIES  # noqa: E402
from freshet.session import build_session  # noqa: E402

HEADLINE = [
    "canonical_urls", "page_links", "page_links_filtered", "page_links_selector", "same_site_hosts", "link_path_prefixes",
    "fetch_resolution", "new_links", "new_links_step", "known_urls", "known_retained", "known_overflowing", "recent_per_site",
    "site_state", "error_streaks", "after_refill", "timeline_300", "feed_sites", "run_summary_titles", "unread_timeline",
    "site_ranking", "read_retention", "site_defaults",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "freshet-bench",
        spark__master=f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            spark.catalog.clearCache()
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus), "pages": pages,
                "replay_pages_per_sec": round(pages / seconds["new_links"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
