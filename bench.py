"""Benchmark: headline operators on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
code generation), then once timed to completion with a no-op sink over the
full result. ``value`` is the total of the timed runs in seconds.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from statgate.plans import catalog  # noqa: E402
from statgate.session import build_session  # noqa: E402

HEADLINE = [
    "stats_events",
    "stats_orders",
    "rules_events",
    "fluctuations_orders",
    "series_signals_orders",
    "data_holes_orders",
    "quality_first_dup_documents",
    "quality_first_dup_lineitem",
    "quality_verdict_lineitem",
    "shard_manifest_lineitem",
    "diff_status_orders",
    "rules_differ_orders",
    "failure_samples_events",
    "top_lint",
    "review_node_checks",
    "bulk_classify",
    "run_events_parse",
    "run_status_replay",
    "advisory_export",
    "validate_many",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # warm the session
    times: dict[str, float] = {}
    for name in only:
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        t = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else None,
                "cpus": int(cpus),
                "rows_per_sec": {
                    "stats_events": round(events / times["stats_events"]) if times.get("stats_events") else None,
                    "quality_first_dup_lineitem": round(lineitem / times["quality_first_dup_lineitem"])
                    if times.get("quality_first_dup_lineitem")
                    else None,
                    "run_events_parse": round(events / times["run_events_parse"]) if times.get("run_events_parse") else None,
                },
            }
        )
    )


if __name__ == "__main__":
    main()
