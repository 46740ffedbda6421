"""Weighted medians, weighted MAD and modified z-scores over pools of any size.

The weighted median is the first value whose cumulative weight exceeds half of the
pool's weight. A pool may hold a large share of all rows, so it is never sorted as a
whole: weights are summed per coarse bucket of the value, the bucket holding the
median is found from that short histogram, and only its rows go on to a finer bucket
and finally to an exact search over distinct values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import contract as C
from ledgerloom.session import stage

WEIGHT = "decimal(28,6)"
Bucket = Callable[[Column], Column]


def widths(*steps: float) -> tuple[Bucket, ...]:
    """Equal-width buckets, coarse to fine. Any non-decreasing mapping of the value is valid."""
    return tuple(lambda v, s=s: F.floor(v / F.lit(s)) for s in steps)


# Logs of unit costs lie within -33..56, which bounds the first histogram at 712 rows per
# pool; each further one has at most 1024. The search ends early, at the first level whose
# crossing buckets are small enough to order, and that is nearly always the second.
LOG_BUCKETS = widths(2.0**-3, 2.0**-13, 2.0**-23, 2.0**-33)
SORTED_ROWS = 100_000


def _crossing(weights: DataFrame, pool: list[str], by: str, weight: str = "_w", *more: str) -> DataFrame:
    """The row per pool where the running weight passes half, with the weight ``_below`` it.

    Input columns ``_below`` and ``_total`` of an earlier step are carried along, as are ``more``.
    """
    keys = ", ".join(pool)
    upto = f"sum({weight}) OVER (PARTITION BY {keys} ORDER BY {by} ROWS UNBOUNDED PRECEDING)"
    carried = ["_below", "_total", "_pool_n"]
    if "_total" not in weights.columns:
        carried = [
            "0 AS _below",
            f"sum({weight}) OVER (PARTITION BY {keys}) AS _total",
            f"sum(_n) OVER (PARTITION BY {keys}) AS _pool_n",
        ]
    running = weights.selectExpr(*pool, by, weight, *more, *carried, f"{upto} AS _upto")
    before = f"_below + _upto - {weight}"
    return running.where(f"(_below + _upto) * 2 > _total AND ({before}) * 2 <= _total").selectExpr(
        *pool, by, f"CAST({before} AS {WEIGHT}) AS _below", f"CAST(_total AS {WEIGHT}) AS _total", "_pool_n", *more
    )


def weighted_median(
    df: DataFrame,
    pool: list[str],
    value: str,
    weight: str,
    buckets: tuple[Bucket, ...] = LOG_BUCKETS,
    name: str = "median",
) -> DataFrame:
    """One row per pool: ``pool…, name, pool_rows``. Non-positive weights take no part.

    ``pool_rows`` counts the rows that took part.
    """
    rows = df.select(*pool, F.col(value).alias("_v"), F.col(weight).cast(WEIGHT).alias("_w")).where(
        F.col("_v").isNotNull() & (F.col("_w") > 0)
    )
    carried: list[str] = []
    for bucket in buckets:
        rows = rows.withColumn("_b", bucket(F.col("_v")))
        histogram = rows.groupBy(*pool, "_b", *carried).agg(
            F.sum("_w").cast(WEIGHT).alias("_w"),
            F.count(F.lit(1)).alias("_rows"),
            *([] if carried else [F.count(F.lit(1)).alias("_n")]),
        )
        # One row per pool. Being written, its size is known to the planner: it broadcasts a
        # small table, so the rows are not shuffled, and merges with a large one.
        found = stage(_crossing(histogram, pool, "_b", "_w", "_rows"), "crossing")
        rows = rows.drop(*carried).join(found.drop("_rows"), [*pool, "_b"])
        carried = ["_below", "_total", "_pool_n"]
        if (found.agg(F.max("_rows")).first()[0] or 0) <= SORTED_ROWS:
            break
    distinct = rows.groupBy(*pool, "_v", *carried).agg(
        F.sum("_w").cast(WEIGHT).alias("_w"), *([] if carried else [F.count(F.lit(1)).alias("_n")])
    )
    return _crossing(distinct, pool, "_v").select(
        *pool, F.col("_v").alias(name), F.col("_pool_n").alias("pool_rows")
    )


def weighted_mad(
    df: DataFrame,
    pool: list[str],
    value: str,
    weight: str,
    centers: DataFrame,
    buckets: tuple[Bucket, ...] = LOG_BUCKETS,
    center: str = "median",
    name: str = "mad",
) -> DataFrame:
    """Weighted median of the absolute deviations from each pool's ``center``."""
    deviations = df.select(*pool, value, weight).join(centers.select(*pool, center), pool).withColumn(
        "_dev", F.abs(F.col(value) - F.col(center))
    )
    return weighted_median(deviations, pool, "_dev", weight, buckets, name).drop("pool_rows")


def effective_mad(mad: Column) -> Column:
    """The MAD, but at least log1p(0.005)."""
    return F.greatest(mad, F.lit(C.MIN_LOG_MAD))


def modified_z(value: Column, center: Column, mad: Column) -> Column:
    return F.when(mad > 0, F.lit(C.Z_SCALE) * (value - center) / mad)


def grade(score: Column) -> Column:
    """Level of a score by its size; NULL stays NULL."""
    size = F.abs(score)
    return (
        F.when(size > C.HIGH_LIMIT, C.LEVEL_HIGH)
        .when(size > C.WATCH_LIMIT, C.LEVEL_WATCH)
        .when(size.isNotNull(), C.LEVEL_NORMAL)
    )


def pool_statistics(
    df: DataFrame, pool: list[str], value: str, weight: str, buckets: tuple[Bucket, ...] = LOG_BUCKETS
) -> DataFrame:
    """Median, raw MAD and size of each pool with at least MIN_POOL_SIZE values.

    The few columns needed are written once, as every search step reads them again.
    """
    df = stage(df.select(*pool, value, weight), "pool_values")
    centers = weighted_median(df, pool, value, weight, buckets).where(F.col("pool_rows") >= C.MIN_POOL_SIZE)
    centers = stage(centers, "centers")
    mads = weighted_mad(df, pool, value, weight, centers, buckets)
    return stage(centers.join(mads, pool), "pool_statistics")
