"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
number of local cores. Every query is run once to warm up and then BENCH_RUNS
times; its time is the median, from building the DataFrame to computing all of
its rows and columns.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from newsloom.catalog import QUERIES  # noqa: E402
from newsloom.session import build_session  # noqa: E402

HEADLINE = [
    "clean_text",
    "page_articles",
    "main_text",
    "rendered_articles",
    "keywords_cascade",
    "decode_body",
    "dedupe_events",
    "merge_new",
    "merge_metrics",
    "skip_processed",
    "category_counts",
    "category_ranking",
    "category_share",
    "category_filter",
    "category_report",
    "output_summary",
    "newest_large",
    "batch_plan",
    "scan_outcome",
    "batch_progress",
    "scan_outcome_repeats",
    "append_corpus",
    "category_analysis",
    "page_category_listing",
    "range_scan",
    "post_filter_export",
    "stream_ingest",
    "stream_category_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "newsloom-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in HEADLINE:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
