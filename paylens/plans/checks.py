"""Plan inspection: the physical plan text and simple structural counts.

Used by tests and the benchmark to assert the plan we want (one scan, a
broadcast hash join on the name keys, partial aggregation before the shuffle,
no Python worker on the hot path).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas",
                "PythonMapInArrow", "MapInArrow")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What ``df.explain(mode)`` prints, as a string."""
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def node_counts(df: DataFrame) -> dict[str, int]:
    """Counts of interesting physical operators in the (initial) plan tree."""
    tree = plan_text(df, "simple")
    names = ["Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin",
             "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "SortAggregate",
             "ObjectHashAggregate", "TakeOrderedAndProject", "Generate", "FileScan",
             "Scan", "Window", *PYTHON_NODES]
    out = {}
    for n in names:
        out[n] = len(re.findall(rf"(?<![A-Za-z]){n}(?![A-Za-z])", tree))
    out["FileScans"] = len(re.findall(r"(?<![A-Za-z])(?:FileScan|BatchScan)(?![A-Za-z])", tree))
    out["ShuffleExchange"] = len(re.findall(
        r"(?<![A-Za-z])Exchange (?:hashpartitioning|rangepartitioning|SinglePartition|"
        r"RoundRobinPartitioning)", tree))
    return out
