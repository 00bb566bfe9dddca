"""Situation overview: totals at every level of the given dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def overview(df: DataFrame, dims: list[str], measures: dict[str, Column], depth: str = "cube") -> DataFrame:
    """Totals for all subsets of `dims` (cube) or all prefixes (rollup).

    `level` is grouping_id: bit set where a dimension is totalled. Rows are
    first folded to the finest level, so only those groups are expanded.
    Measures are sums; each value of `measures` is a per-row amount.
    """
    fine = df.groupBy(*dims).agg(*[F.sum(m).alias(name) for name, m in measures.items()])
    grouped = fine.cube(*dims) if depth == "cube" else fine.rollup(*dims)
    return grouped.agg(
        F.grouping_id().cast("int").alias("level"),
        *[F.sum(name).alias(name) for name in measures],
    )
