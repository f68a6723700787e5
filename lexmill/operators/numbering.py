"""Numbers in an order over a whole table, without a task that holds or sorts all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged
from .alike import alike


def positions(rows: DataFrame, order: list[Column | str], name: str, path: str | None = None) -> DataFrame:
    """``rows`` with their 0-based place in ``order``, which must tell rows apart for the numbers to be the same each time.

    Rows are dealt to tasks by ranges of the order and counted there; a task's numbers begin after what the tasks before it hold, which takes one
    row of each task. Equal keys and sparse or hashed ones spread like any other. The dealt rows are stored meanwhile, at ``path`` if a caller names one.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    dealt = staged(dealt, "positions", path).withColumn("__task", F.shiftright("__m", 33))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = dealt.groupBy("__task").count().select("__task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    within = F.col("__m") - F.shiftleft("__task", 33)
    return dealt.join(F.broadcast(starts), "__task").withColumn(name, F.col("__start") + within).drop("__m", "__task", "__start")


def ordinals(rows: DataFrame, group: str, order: str, name: str = "ordinal") -> DataFrame:
    """``rows`` with their 0-based dense rank by ``order`` within ``group``: places over the whole table, less that of the group's first."""
    placed = positions(rows.select(group, order).distinct(), [F.col(group), F.col(order)], "__place")
    starts = placed.groupBy(group).agg(F.min("__place").alias("__first"))
    ranked = alike(placed, starts, [group]).select(group, order, (F.col("__place") - F.col("__first")).alias(name))
    return alike(rows, ranked, [group, order])
