"""Numbers of partitions by the size of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input, as the planner estimates them (those of its files), of one task's share; most partitions.
SHARE, MOST = 16 << 20, 4096


def shares(df: DataFrame) -> int:
    """So many partitions that a task's share doesn't grow with the input; the session's number where that is more or the size isn't known."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return usual if size >= 1 << 60 else max(usual, min(MOST, -(-size // SHARE)))
