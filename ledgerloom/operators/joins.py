"""Left lookup join that stays balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Any key with more than 1/1024 of all rows is among the 1024 most frequent keys, so
# this many are enough to find every key that could unbalance a join.
MAX_HOT_KEYS = 1024
ROWS_PER_SALT = 1_000_000


def hot_keys(rows: DataFrame, keys: list[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """At most MAX_HOT_KEYS keys with more than ``rows_per_salt`` rows, with ``_salts``."""
    return hot_of_counts(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, rows_per_salt)


def hot_of_counts(counts: DataFrame, keys: list[str], rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """:func:`hot_keys` from known counts ``_n`` per key, without another pass over the rows."""
    busy = counts.where(F.col("_n") > rows_per_salt).orderBy(F.desc("_n")).limit(MAX_HOT_KEYS)
    return busy.select(*keys, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts"))


def lookup_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], hot: DataFrame, spread_by: str
) -> DataFrame:
    """``rows`` LEFT JOIN ``lookup`` (one row per key) with hot keys spread over salts.

    ``hot`` comes from :func:`hot_keys`, so broadcasting it is bounded. Each lookup row
    of a hot key is repeated once per salt; rows choose a salt by hashing ``spread_by``.
    Where no key is hot, the rows are joined by their keys alone, and a lookup that was made by an aggregate
    over the keys is not shuffled again. ``hot`` is read for that, so it should be staged.
    """
    if hot.isEmpty():
        return rows.join(lookup, keys, "left")
    hot = F.broadcast(hot)
    salted = rows.join(hot, keys, "left").withColumn(
        "_salt", F.pmod(F.hash(spread_by), F.coalesce("_salts", F.lit(1)))
    )
    copies = lookup.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    return salted.drop("_salts").join(copies.drop("_salts"), [*keys, "_salt"], "left").drop("_salt")
