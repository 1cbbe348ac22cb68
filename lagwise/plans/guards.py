"""Plan checks: shapes that break at scale, found in a DataFrame's physical plan.

* a window with no partition key (the whole table goes to one task);
* a cartesian product or nested-loop join (pairs every row with every row);
* a row-at-a-time Python UDF (``BatchEvalPython``; Arrow batches are fine).
Global aggregates also end in a single partition, but after map-side partial
aggregation, so they are not flagged.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plan_violations(df: DataFrame) -> list[str]:
    text = plan_text(df)
    found = [name for name in _FORBIDDEN if name in text]
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            below = "\n".join(lines[i + 1:i + 4])
            if "Exchange SinglePartition" in below:
                found.append("Window over a single partition")
    return found
