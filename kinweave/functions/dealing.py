"""Tasks of bounded size for joins and groups of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task.
TASK_ROWS = 500_000


def tasks(df: DataFrame, rows: int) -> int | None:
    """How many tasks ``rows`` rows ask for; None where each core gets fewer than `TASK_ROWS`, which adaptive execution sees to."""
    n = -(-rows // TASK_ROWS)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows hashed by ``keys`` into as many tasks as its rows ask for.

    A number of tasks that stays the same, and one that adaptive execution derives from compressed bytes, let the memory
    of a task grow with the table. Small tables are returned as they are.
    """
    n = tasks(df, rows)
    return df if n is None else df.repartition(n, *keys)
