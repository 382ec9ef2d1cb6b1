"""Running totals and minima over a whole ordered table, without sending it to one task.

Rows are range-partitioned; a window runs inside each range, and the totals of the ranges (one row each)
give the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.columns import fresh
from kinweave.functions.durable import durable


def ranged(df: DataFrame, *order: str, range_no: str = "range_no") -> DataFrame:
    """``df`` written in ranges of ``order``; ``range_no`` names each row's range."""
    return durable(df.repartitionByRange(*order).withColumn(range_no, F.spark_partition_id()))


def placed_in_order(df: DataFrame, by: list[str], order: list[str], keep: list[str], out: str, n: int | None = None) -> DataFrame:
    """``by`` and ``keep`` of each row with its place (from 0) among the rows of the same ``by`` in the order of ``order``.

    One shuffle into ranges, ``n`` if given: a row's number in its sorted range is taken as the range is written, so neither a window nor
    what the order was by is shuffled after it.
    """
    rest = [*by, *keep]
    at, first, before = fresh(df, "at", "first", "before")
    ranges = df.repartitionByRange(*([n] if n else []), *by, *order).sortWithinPartitions(*by, *order)
    # the range's number is in the upper bits, the row's in the lower 33
    table = durable(ranges.select(*rest, F.monotonically_increasing_id().alias(at)))
    range_no = fresh(table, "range_no")[0]
    table = table.withColumn(range_no, F.shiftright(at, 33))
    parts = table.groupBy(*by, range_no).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(*by).orderBy(range_no).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, range_no, first, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    return table.join(F.broadcast(parts), [*by, range_no]).withColumn(out, F.col(at) - F.col(first) + F.col(before)).select(*rest, out)


def running_sum(table: DataFrame, by: list[str], order: str | list[str], value: str, out: str, range_no: str = "range_no") -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same ``by`` up to this one. ``table`` is `ranged` by (by, order)."""
    own = Window.partitionBy(*by, range_no).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy(range_no).rowsBetween(Window.unboundedPreceding, -1)
    inside, part, offset = fresh(table, "inside", "part", "offset")
    parts = table.groupBy(*by, range_no).agg(F.sum(value).alias(part))
    offsets = parts.select(*by, range_no, F.coalesce(F.sum(part).over(before), F.lit(0)).alias(offset))
    rows = table.withColumn(inside, F.sum(value).over(own))
    return rows.join(offsets, [*by, range_no]).withColumn(out, F.col(inside) + F.col(offset)).drop(inside, offset)


def following_min(table: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """Adds the least ``value`` over the rows of the same ``by`` from this one on. ``table`` is `ranged` by (by, order).

    Windows run downwards: a frame that ends at the last row is computed anew for each row, in quadratic time.
    """
    own = Window.partitionBy(*by, "range_no").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*by).orderBy(F.desc("range_no")).rowsBetween(Window.unboundedPreceding, -1)
    inside, part, offset = fresh(table, "inside", "part", "offset")
    parts = table.groupBy(*by, "range_no").agg(F.min(value).alias(part))
    offsets = parts.select(*by, "range_no", F.min(part).over(after).alias(offset))
    rows = table.withColumn(inside, F.min(value).over(own))
    return rows.join(offsets, [*by, "range_no"]).withColumn(out, F.least(inside, offset)).drop(inside, offset)
