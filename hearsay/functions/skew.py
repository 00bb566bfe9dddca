"""Joins that stay balanced when one key holds a large part of the rows.

AQE splits skewed shuffle partitions of a join by itself and is left to do so
where nothing is known beforehand. Where a table of key counts exists anyway,
the salting below does not depend on partition sizes measured at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fewer than `share` keys can each hold more than 1/share of the rows, so a list of
# hot keys has fewer than `share` entries whatever the data is like. Joins take a
# longer list, of one short row per key, and so leave smaller keys unsalted.
HOT_SHARE = 1000
JOIN_SHARE = 50_000
HOT_FLOOR = 100_000


def hot_keys(counts: DataFrame, key: str, floor: int | None = None, share: int | None = None) -> DataFrame | None:
    """(key, _salts) for keys above `floor` rows and above 1/share of all rows.

    `counts` has one row (key, n) per key and should be cheap to read twice.
    None if no key is hot.
    """
    floor, share = HOT_FLOOR if floor is None else floor, HOT_SHARE if share is None else share
    largest, total = counts.agg(F.max("n"), F.sum("n")).first()
    if not total or largest <= max(floor, total / share):
        return None
    edge = max(floor, total / share)
    hot = counts.where(F.col("n") > edge).select(
        key, F.ceil(F.col("n") / F.lit(edge)).cast("int").alias("_salts")
    )
    rows = hot.collect()
    return counts.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def spread_join(
    many: DataFrame,
    one: DataFrame,
    key: str,
    spread: Column,
    counts: DataFrame,
    how: str = "inner",
    floor: int | None = None,
) -> DataFrame:
    """Equi join of `many` with `one`, which has few rows per key.

    Rows of hot keys are salted by `spread`, a value that differs between the
    rows of a key and never changes on a retry; the matching rows of `one` are
    copied once per salt. Without hot keys this is the plain join.
    """
    hot = hot_keys(counts, key, floor, JOIN_SHARE)
    if hot is None:
        return many.join(one, key, how)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = (
        many.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
        .drop("_salts")
    )
    right = (
        one.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")
