"""Time the headline queries and print one line of JSON.

Reads $BENCH_SF_DIR on local[$BENCH_CPUS]. Every query runs to its last row; the index is built
once, timed as `index_build`, and searched after that.
"""

from __future__ import annotations

import json
import os
import time

from foliary.catalog import fixtures as fx
from foliary.catalog.queries import QUERIES
from foliary.session import local_session

HEADLINE = (
    "apply_seen",
    "reconcile_sweep",
    "apply_outcomes",
    "ingest_jobs",
    "reindex",
    "extract_text",
    "tokenize",
    "postings",
    "term_stats",
    "fuzzy_terms",
    "search_page",
    "search_many",
    "search_hits",
    "expand_dictionary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "foliary-bench")
    spark.sparkContext.setLogLevel("ERROR")
    fx.table(spark, sf_dir, "documents").count()

    seconds: dict[str, float] = {}
    began = time.perf_counter()
    fx.index(spark, sf_dir)
    seconds["index_build"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
