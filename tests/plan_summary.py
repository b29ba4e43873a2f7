"""Summarise the physical plan of the registered queries, as planned before a run.

Usage: python tests/plan_summary.py [sf_dir] > PLANS.md
Times each query once (noop sink) and lists what Spark planned: shuffles,
broadcasts, join and aggregate strategies, pushed filters on the scans. AQE
may still turn sort-merge joins into broadcast joins while a query runs.
"""

from __future__ import annotations

import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def summarise(plan: str) -> dict:
    count = lambda pat: len(re.findall(pat, plan))
    joins = []
    for kind in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin"):
        for m in re.finditer(kind + r"(?: \[[^\]]*\], \[[^\]]*\],)? ?(\w+)", plan):
            joins.append(f"{kind.replace('Join', '')}:{m.group(1)}")
    pushed = sorted({m.group(1) for m in re.finditer(r"file:[^\]]*/(\w+)\.parquet\].*?PushedFilters: \[([^\]]*)\]", plan)
                     if m.group(2)})
    return {
        "shuffles": count(r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange SinglePartition|\bExchange RoundRobin"),
        "broadcasts": count(r"BroadcastExchange"),
        "joins": ", ".join(sorted(set(joins))) or "-",
        "aggregates": ", ".join(sorted({a for a in re.findall(r"\b(HashAggregate|SortAggregate|ObjectHashAggregate)\(", plan)})) or "-",
        "windows": count(r"\bWindow \["),
        "pushed": ", ".join(pushed) or "-",
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from hourbook.session import get_spark
    from hourbook.plans.catalog import QUERIES
    spark = get_spark("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    print(f"# Physical plans of the registered queries ({os.path.basename(sf_dir)}, local[8])\n")
    print("Plans as made before the run (AQE may still change joins). `shuffles` counts hash/range exchanges, "
          "`broadcasts` the planned broadcast exchanges; scans listed under "
          "`pushed` received Parquet pushed filters.\n")
    print("| query | sec | shuffles | broadcasts | joins | aggregates | windows | pushed-filter scans |")
    print("|---|---|---|---|---|---|---|---|")
    from hourbook.plans.stream_queries import STREAM_QUERIES
    for name, fn in sorted(QUERIES.items()):
        if name in STREAM_QUERIES:          # run whole streams; their result is a Parquet scan
            continue
        df = fn(spark, sf_dir)
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        secs = time.perf_counter() - t
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        print(f"| {name} | {secs:.2f} | {s['shuffles']} | {s['broadcasts']} | {s['joins']} | "
              f"{s['aggregates']} | {s['windows']} | {s['pushed']} |")


if __name__ == "__main__":
    main(sys.argv)
