"""Events that live on: every batch of mentions extends, opens, merges and retires events.

What is known lies in two tables. `EVENTS` has an event's mean vector, the number
of its mentions, the last batch that touched it and whether it is retired. `ALIASES` says
under which id an event of an older id goes on; it is kept flat, so one join leads from
any id ever given to the current one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.vectors import BROADCAST_ROWS
from ..session import cut
from .grouping import TOGETHER, alike_links, assign_events, centroids_of, components

EVENTS = "event_id bigint, vector array<double>, weight bigint, last_batch int, retired boolean"
ALIASES = "old_id bigint, event_id bigint"


def no_events(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(events, aliases) before the first batch."""
    return spark.createDataFrame([], EVENTS), spark.createDataFrame([], ALIASES)


def advance(
    events: DataFrame, aliases: DataFrame, mentions: DataFrame, id: str, vector: str, batch: int, min_similarity: float,
    together: float = TOGETHER, merge_at: float = 0.9, retire_after: int = 30, bound: int = BROADCAST_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assigned, events, aliases) after one batch, all three written.

    `mentions` join live events as in `assign_events`; `assigned` has its columns. An
    event's vector is the mean over all its mentions so far. Then each live event is
    linked to the nearest other one if they are `merge_at` alike; linked events become
    one, under their smallest id, which is the oldest. An event that no mention of the last
    `retire_after` batches joined retires: it keeps its row and matches nothing more.
    """
    live = cut(events.where(~F.col("retired")))
    assigned = cut(assign_events(mentions, id, vector, live.select("event_id", "vector"), min_similarity, bound, together))
    joined = mentions.select(id, vector).join(assigned.where("event_id is not null").select(id, "event_id"), id)
    sizes = assigned.where("event_id is not null").groupBy("event_id").agg(F.count(F.lit(1)).alias("_n"))
    fresh = centroids_of(joined, "event_id", vector).withColumnRenamed("vector", "_mean").join(sizes, "event_id")
    met = live.join(fresh, "event_id", "full")
    weight = F.coalesce("weight", F.lit(0)) + F.coalesce("_n", F.lit(0))
    mean = F.when(F.col("_n").isNull(), F.col("vector")).when(F.col("weight").isNull(), F.col("_mean")).otherwise(
        F.zip_with("vector", "_mean", lambda old, new: (old * F.col("weight") + new * F.col("_n")) / (F.col("weight") + F.col("_n"))))
    touched = F.when(F.col("_n").isNull(), F.col("last_batch")).otherwise(F.lit(batch))
    updated = cut(met.select("event_id", mean.alias("vector"), weight.alias("weight"), touched.cast("int").alias("last_batch")))

    merged, renamed = _merge(updated, merge_at, bound)
    stays = F.col("last_batch") > F.lit(batch - retire_after)
    after = merged.withColumn("retired", ~stays).unionByName(events.where("retired")).select("event_id", "vector", "weight", "last_batch", "retired")
    if renamed is not None:
        moved = aliases.join(renamed.toDF("event_id", "_new"), "event_id", "left").select("old_id", F.coalesce("_new", "event_id").alias("event_id"))
        aliases = moved.unionByName(renamed)
    return assigned, cut(after), cut(aliases)


def _merge(events: DataFrame, merge_at: float, bound: int) -> tuple[DataFrame, DataFrame | None]:
    """(events after their union, (old_id, event_id) of those that went on under another id, None if none did)."""
    links = cut(alike_links(events.select(F.col("event_id").alias("id"), "vector"), merge_at, bound))
    if links.isEmpty():
        return events, None
    labels = cut(components(links, "a", "b").select(F.col("id").alias("old_id"), "event_id"))
    tied = events.withColumnRenamed("event_id", "old_id").join(labels, "old_id")
    cells = tied.select("event_id", "weight", F.posexplode("vector").alias("pos", "x"))
    means = cells.groupBy("event_id", "pos").agg((F.sum(F.col("x") * F.col("weight")) / F.sum("weight")).alias("x"))
    vectors = means.groupBy("event_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("vector"))
    facts = tied.groupBy("event_id").agg(F.sum("weight").alias("weight"), F.max("last_batch").alias("last_batch"))
    whole = vectors.join(facts, "event_id").select(*events.columns)
    alone = events.join(labels.select(F.col("old_id").alias("event_id")), "event_id", "left_anti")
    return alone.unionByName(whole), labels.where("old_id <> event_id")


def current(rows: DataFrame, aliases: DataFrame, event: str = "event_id", name: str = "current_id") -> DataFrame:
    """Add the id under which the event of each row goes on now."""
    known = aliases.select(F.col("old_id").alias(event), F.col("event_id").alias("_now"))
    return rows.join(known, event, "left").withColumn(name, F.coalesce("_now", event)).drop("_now")
