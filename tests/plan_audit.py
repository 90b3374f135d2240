"""Print a markdown table of the physical plan shape of every registered query.

Usage: python tests/plan_audit.py [sf_dir]   (default /root/testdata/sf0.001)

Columns: ledger scans (reads of the adapter's fact table), shuffles (hash /
range exchanges), broadcasts, sort aggregates, windows and their partition
keys.  The plan is the executed (final adaptive) plan.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def shape(plan: str) -> dict:
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[", plan)
    keys = sorted({", ".join(re.sub(r"#\d+L?", "", k).split(", ")) for k in windows})
    return {
        "scans": plan.count("orders.parquet") + plan.count("events.parquet"),
        "shuffles": len(re.findall(r"Exchange (hash|range)partitioning", plan)),
        "single": plan.count("Exchange SinglePartition"),
        "broadcasts": plan.count("BroadcastExchange"),
        "sortagg": plan.count("SortAggregate") // 2,
        "windows": "; ".join(keys) if keys else "",
    }


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    import __spark_entry__ as E
    from fundflow.session import local_session
    spark = local_session(8)
    print("| query | ledger scans | hash/range shuffles | 1-row gathers | broadcasts "
          "| sort aggs | window partition keys |")
    print("|---|---|---|---|---|---|---|")
    for name, fn in ((n, q) for n, q in E.queries().items() if n in E.SCENARIOS):
        df = fn(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = shape(df._jdf.queryExecution().executedPlan().toString())
        print(f"| `{name}` | {s['scans']} | {s['shuffles']} | {s['single']} | {s['broadcasts']} "
              f"| {s['sortagg']} | {s['windows']} |")


if __name__ == "__main__":
    main(sys.argv)
