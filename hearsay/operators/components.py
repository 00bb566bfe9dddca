"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, event_id) for every linked id; event id = smallest id it is connected to.

    Alternates two steps on the edge list: every node links its larger
    neighbours to the smallest one it sees, then its smaller neighbours. Chains
    shorten by a factor each round, so long chains need few rounds. A node takes
    part in a join with its own minimum only, one row; where very many edges meet in one
    node, the skew handling of the join splits them.
    """
    edges = cut(_down(links.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    while not _is_star_forest(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = cut(_relink(both, "v > u"))
        edges = cut(_down(_relink(larger.unionByName(larger.select("u", F.col("u").alias("v"))), "v <= u")))
    centres = edges.select(F.col("v").alias("id"), F.col("v").alias("event_id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("event_id")).unionByName(centres)


def _is_star_forest(edges: DataFrame) -> bool:
    """Every larger id has one smaller neighbour, which has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller id."""
    return edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()


def _relink(edges: DataFrame, side: str) -> DataFrame:
    """For every u, link the neighbours on one side of it to its least neighbour."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    found = edges.where(side).join(least, "u")
    return found.select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
