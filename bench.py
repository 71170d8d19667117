"""Times the headline queries and prints one JSON line.

Settings: BENCH_SF_DIR (data folder), BENCH_CPUS (cores), BENCH_ALL=1 (every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time

from papyrine.catalog import QUERIES
from papyrine.catalog.registry import Corpus
from papyrine.catalog.searching import stored_index
from papyrine.session import spark_session

HEADLINE = [
    "search_title",
    "search_abstract",
    "index_build",
    "search_postings",
    "postings",
    "postings_refresh",
    "search_many",
    "title_candidates",
    "title_match",
    "verify_pages",
    "partial_ratio",
    "extract_abstract",
    "reconstruct_abstract",
    "transform_metadata",
    "fallback_queue",
    "source_plan",
    "missing_by_journal",
    "corpus_stats",
    "best_candidate",
    "latest_status",
    "upsert_articles",
    "fill_abstract",
    "quarantine",
    "bib_keys",
    "index_by_journal",
    "reconcile",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = spark_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        # Small local files: let one file be read by several tasks.
        spark__sql__files__maxPartitionBytes="4m",
        spark__sql__files__openCostInBytes="1m",
        # The texts lie in files of one row group, which no task can share.
        spark__papyrine__inputPartitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM code paths and the Python workers outside the timings.
    QUERIES["search_title"](spark, folder).write.format("noop").mode("overwrite").save()
    QUERIES["partial_ratio"](spark, folder).write.format("noop").mode("overwrite").save()
    # Indexes are built before the queries that ask them; ``index_build`` times a build.
    for use in ("search", "refresh"):
        stored_index(Corpus(spark, folder), use)
    times: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
