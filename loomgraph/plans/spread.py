"""Dealing rows to as many tasks as their number asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

#: Rows that a task sorts or groups on average: of terms, some tens of MB.
TASK_ROWS = 1 << 18


def shares(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def tasks(df: DataFrame, rows: int) -> int:
    """Tasks for so many rows, never fewer than Spark would take."""
    return max(shares(rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """df dealt by the keys, if so many rows are too many for a task.

    Terms shrink to a few bytes in a shuffle, so partitions that Spark puts together by their shuffled bytes are many times
    larger in memory; those dealt to a number are left as they are. Joins and groupings by these keys, or by these and
    more, then need no other shuffle.
    """
    return df if rows <= TASK_ROWS else df.repartition(tasks(df, rows), *keys)


def ranged(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """df dealt to ranges of the order, as many as spread() would make."""
    return df.repartitionByRange(*order) if rows <= TASK_ROWS else df.repartitionByRange(tasks(df, rows), *order)
