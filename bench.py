"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  input folder   (default /root/testdata/sf0.1)
BENCH_CPUS    local threads  (default 8)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from platen.plans import QUERIES

HEADLINE = [
    "trap_prevalence", "trap_scores", "chain_validation", "magic_sniff", "artifact_measurement",
    "page_text", "page_markdown", "markdown_html", "text_markdown", "lead_summaries", "document_records",
    "reading_positions", "order_differences", "off_page_audit", "archive_entries", "word_round_trip",
    "corpus_run_verdicts", "fail_stop_log", "merged_notes", "latest_runs", "shared_string_cells",
]
REPEATS = 4


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("platen-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
    timings: dict[str, float] = {}
    for name in names:
        samples = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(samples[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
