"""Time the headline queries: one warm-up, then the median of some runs, into the noop sink.

Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from chronotext.plans.catalog import QUERIES
from chronotext.session import build_session

HEADLINE = (
    "word_count dtm_vocabulary dtm_sparse_docs lda_token_counts title_overlap corpus_overlap "
    "first_year_groups year_windows js_pairs js_nearest_year js_mean_by_year_gap "
    "topic_lowest_terms topic_listing doc_topic_scores year_pair_arcs lda_topics lda_nearest_year"
).split()


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, name, folder)
        seconds[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
