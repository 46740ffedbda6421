"""Range-sorted running totals without one sorted task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stage

PART = "_part"


def range_sorted(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Write ``df`` range-sorted by ``order`` and give each row the number of its range.

    The written table fixes the ranges, so a lost task reads the same rows again.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ranged.withColumn(PART, F.spark_partition_id()), name)


def running_total(ranged: DataFrame, order: list[Column], value: str, total: str) -> DataFrame:
    """Add ``total``: the sum of ``value`` over all rows up to and including this one.

    ``ranged`` comes from ``range_sorted`` with the same ``order``. Sums of ranges (one row
    each) are run through first; inside a range a window continues from the sum before it.
    """
    sums = ranged.groupBy(PART).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(PART, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(sums, PART)
        .withColumn(total, F.col("_before") + F.sum(value).over(inside))
        .drop("_before", PART)
    )
