"""Physical-plan audit of every registered query (run after execution, so AQE's final plan is seen).

Reports per query: parquet scans per table, shuffle exchanges, single-partition
exchanges and Python nodes.  ``python tests/plan_audit.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def audit(df) -> dict:
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    tables = re.findall(r"FileScan parquet [^\n]*?Location: InMemoryFileIndex[^\n]*?/([a-z_]+)\.parquet", plan)
    if not tables:
        tables = re.findall(r"/([a-z_]+)\.parquet\]", plan)
    per = {}
    for t in tables:
        per[t] = per.get(t, 0) + 1
    return {
        "scans": per,
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan)),
        "single_partition": plan.count("SinglePartition"),
        "python": len(re.findall(r"(ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas)", plan)),
        "reused": plan.count("ReusedExchange"),
    }


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from dialframe.session import local_session
    import __spark_entry__ as entry
    spark = local_session(shuffle_partitions=8)
    for name, build in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        print(name, audit(build(spark, sf)), flush=True)
