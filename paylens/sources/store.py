"""Canonical Parquet store: parse CSV once, report many times.

CSV gives the optimizer little (no statistics, no pushdown, whole-file tasks
with ``multiLine``). Writing the canonical rows once as Parquet partitioned by
``year`` turns every later report into a pruned, column-projected scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_canonical(canonical: DataFrame, path: str, mode: str = "append", by: Sequence[str] = ()) -> str:
    """Persist canonical rows (invalid amounts included, for A13) by ``by`` and year.

    Rows are rebalanced by the folders first: a small year is one file whatever the
    number of tasks, and a year holding most of the rows is split over many."""
    folders = [*by, "year"]
    (canonical.hint("rebalance", *[F.col(c) for c in folders]).sortWithinPartitions(*folders, "source_file", "row_pos")
     .write.mode(mode).partitionBy(*folders).parquet(path))
    return path


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """The store as a canonical DataFrame; ``year`` filters prune folders."""
    return spark.read.parquet(path)
