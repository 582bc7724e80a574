"""Placement of rows before heavy work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread_rows(df: DataFrame, *by: str) -> DataFrame:
    """Hash-partition few and large rows, such as contigs out of one compressed file, which one task
    would otherwise cut alone."""
    return df.repartition(*by)


#: Slim rows that a task of a sort or a hash table should hold.
TASK_ROWS = 200_000


def row_tasks(df: DataFrame, rows: int | None = None) -> int:
    """Tasks for the rows of a given table, so that one holds about `rows` of them at any size.

    Adaptive execution joins shuffle blocks by their compressed bytes; sorted keys compress so well that
    such a task sorts millions of rows. An exchange with a number of its own is left as it is.
    """
    return max(1, -(-df.count() // (rows or TASK_ROWS)))


def dealt(df: DataFrame, key: str, tasks: int | None) -> DataFrame:
    """A side of a join by `key` dealt to `tasks`; a join of two sorted sides brings the other one there too."""
    return df.repartition(tasks, key) if tasks else df
