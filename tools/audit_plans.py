"""List physical operators that would not scale: python tools/audit_plans.py [sf]."""

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from slotweave.plans.registry import catalogue
from slotweave.session import local_session

BAD = ["BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython"]


def main():
    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark = local_session(8, 8, app="audit")
    for name, q in catalogue().items():
        plan = q(spark, folder)._jdf.queryExecution().executedPlan().toString()
        found = [b for b in BAD if b in plan]
        lines = plan.split("\n")
        for i, line in enumerate(lines):
            # A window over one partition: its rows must be a table of sizes, never data.
            if re.search(r"\bWindow \[", line) and any("SinglePartition" in x for x in lines[i:i + 4]):
                found.append("single-partition window: " + line.strip()[:120])
        joins = {k: plan.count(k) for k in ("SortMergeJoin", "BroadcastHashJoin", "Exchange hashpartitioning")}
        print(name, joins, found or "", flush=True)


if __name__ == "__main__":
    main()
