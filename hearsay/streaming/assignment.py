"""Assigning arriving mentions to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import living
from ..operators.grouping import assign_events
from ..session import cut
from ..sources.sinks import write_batch
from .live import run_available

EVENTS = "event_id bigint, vector array<double>, batch int"


def live_assignment(
    df: DataFrame, id: str, vector: str, known: str, out: str, min_similarity: float, progress: str | None = None
) -> str:
    """Write (id, event_id, similarity, opened) per batch; add opened events to `known`.

    `known` is a table of (event_id, vector) with a folder per batch. A batch
    reads the events of earlier batches only and replaces its own folder, so a
    repeated batch opens the same events again instead of new ones. With `progress`
    a later call goes on with the mentions that have landed since.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch)
        earlier = spark.read.schema(EVENTS).parquet(known).where(F.col("batch") < batch_id + 1)
        assigned = cut(assign_events(batch, id, vector, earlier.select("event_id", "vector"), min_similarity))
        write_batch(assigned, out, batch_id)
        opened = assigned.where("opened").select(id, "event_id").join(batch.select(id, vector), id)
        fresh = opened.select("event_id", F.col(vector).cast("array<double>").alias("vector")).dropDuplicates(["event_id"])
        write_batch(fresh, known, batch_id + 1)  # folder 0 holds the events known at the start

    return run_available(df, out, each, progress)


def live_events(
    df: DataFrame, id: str, vector: str, folder: str, min_similarity: float, progress: str | None = None, **rules
) -> str:
    """Let events live on over the batches of a stream; gives the folder back.

    Batch b reads the state that batch b - 1 left in `folder` and writes its own:
    `assigned`, `events` and `aliases` have a folder per batch, so a repeated batch replaces
    itself. `rules` are those of `living.advance`. With `progress` a later call goes on.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch)
        events, aliases = living.no_events(spark)
        if batch_id:
            events = read_state(spark, folder, "events", batch_id - 1)
            aliases = read_state(spark, folder, "aliases", batch_id - 1)
        state = living.advance(events, aliases, batch, id, vector, batch_id, min_similarity, **rules)
        for name, table in zip(("assigned", "events", "aliases"), state):
            write_batch(table, f"{folder.rstrip('/')}/{name}", batch_id)

    return run_available(df, folder, each, progress)


def read_state(spark, folder: str, name: str, batch_id: int) -> DataFrame:
    """Events or aliases as one batch left them."""
    schema = {"events": living.EVENTS, "aliases": living.ALIASES}[name]
    return spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{name}/batch={batch_id}")
