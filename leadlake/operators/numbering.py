"""Gap-free order numbers over a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import written

#: Bits of monotonically_increasing_id() below the task's number.
_ROW_BITS = 33


def numbered(rows: DataFrame, order: list[str | Column], name: str = "seq") -> DataFrame:
    """The rows with their place, from 1, in the order of `order` (as Spark sorts: nulls first); rows that tie follow each other in some order.

    Rows are range-partitioned by the order and written with their place inside
    their task; the tasks' sizes, one small row each, add up to what stands before
    each task and are joined back.  An empty table gives none; a column of the
    name is replaced.
    """
    kept = [c for c in rows.columns if c != name]
    # the row travels as one column, so that its own columns may have any name
    whole = rows.select(F.struct(*kept).alias("row"), F.struct(*order).alias("by")).repartitionByRange("by").sortWithinPartitions("by")
    id_ = F.monotonically_increasing_id()
    placed = written(whole.select("row", F.shiftright(id_, _ROW_BITS).alias("task"), id_.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("place")), "placed")
    sizes = placed.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    ends = sizes.withColumn("upto", F.expr("sum(n) OVER (ORDER BY task)"))  # a row a task
    before = ends.select("task", (F.col("upto") - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "task").select("row.*", (F.col("before") + F.col("place") + 1).alias(name))
