"""Row numbers over a whole table without one sorted task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stage

# monotonically_increasing_id counts the rows of a partition in its lower 33 bits
_PLACE_BITS = 33


def row_numbers(df: DataFrame, order: list[Column | str], number: str = "row_number") -> DataFrame:
    """Add ``number``: 1, 2, 3... in the order of ``order``.

    The table is range-sorted and written once, which fixes the ranges and the places in them; a table of one
    row a range gives the rows before it. Rows that tie are numbered in any, but one lasting, order.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(placed.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranged")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select("_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    own = F.col("_place").bitwiseAND((1 << _PLACE_BITS) - 1)
    return placed.join(before, "_range").select(*df.columns, (F.col("_before") + own + 1).alias(number))
