"""Print, for every registered query, physical operators that do not scale."""

from __future__ import annotations

import re
import sys

if __name__ == "__main__":
    import pathlib
    sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
    from canonframe.plans import catalog
    from canonframe.session import build_session

    spark = build_session("local[8]", "plans", 8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in catalog.callables().items():
        if len(sys.argv) > 2 and not any(name.startswith(a) for a in sys.argv[2:]):
            continue
        plan = fn(spark, sys.argv[1])._jdf.queryExecution().executedPlan().toString()
        found = re.findall(r"CartesianProduct|BroadcastNestedLoopJoin|CollectLimit", plan)
        # A window fed by a single partition orders a whole table in one task.
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line and any("Window [" in x for x in lines[max(0, i - 3):i]):
                found.append("one-task window")
        if found:
            print("PLAN", name, sorted(set(found)), flush=True)
    print("checked")
