"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores. Every query is written to the
no-op sink, so all its columns are computed. Each runs twice in one session and the
better time counts; the first times are in ``first_run``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from glossaleaf.plans.queries import QUERIES
from glossaleaf.session import local_session

HEADLINE = [
    "pair_spans", "pairs_to_expressions", "error_memory", "rewrite_attempts", "prompt_translator",
    "intake_valid", "lang_ident", "similar_errors_topk", "diary_detail", "diary_list", "merge_latest_wins",
    "append_new_only", "version_numbers", "version_line_changes", "version_diff", "stream_job_status",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus))
    run(spark, "filter_diary_visible", sf_dir)
    first = {name: run(spark, name, sf_dir) for name in names}
    times = {name: min(first[name], run(spark, name, sf_dir)) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "first_run": first,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
