"""Consecutive numbers for the rows of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import materialize

_LOW = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Rows with consecutive numbers from start on, in an order.

    Rows are dealt and sorted by ranges of the order once, and written with their range and their place
    in it; sizes of ranges and rows then come from that one table. Only a row per range meets in one
    place. Rows of equal order values have any order among themselves.
    """
    at = F.monotonically_increasing_id()  # range and place in it, in a task's order
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at), "ranges")
    part, nth = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(_LOW))
    sizes = ranged.groupBy(part.alias("__part")).agg((F.max(nth) + 1).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))  # a row per range
    placed = ranged.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.withColumn(name, F.lit(start).cast("long") + F.col("__before") + nth).drop("__part", "__at", "__before")
