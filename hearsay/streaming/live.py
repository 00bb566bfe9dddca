"""Live processing of landed files with Structured Streaming."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from ..functions.durations import seconds
from ..functions.text import fingerprint
from ..operators.hot import hot_topk
from ..operators.sentiment import Bayes, score_bayes
from ..session import cut, fresh_path
from ..sources.sinks import commit_batch, write_batch


def stream_mentions(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """Files under `path` as they land, at most `max_files` per micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def with_lateness(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Wait `delay` for late mentions; later ones are dropped from closed windows.

    Watermarks need TIMESTAMP, so a TIMESTAMP_NTZ column is cast (session zone
    UTC). With chained stateful operators a late row may still be counted in the
    first batch after the watermark moved. `dropped_late` counts the rows dropped.
    """
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, f"{seconds(delay)} seconds")


def drop_live_copies(df: DataFrame, text: str) -> DataFrame:
    """First mention of every text within the watermark delay; all mentions of a null text stay."""
    keyed = df.where(F.col(text).isNotNull()).withColumn("_copy", fingerprint(text))
    return keyed.dropDuplicatesWithinWatermark(["_copy"]).drop("_copy").unionByName(df.where(F.col(text).isNull()))


def live_counts(
    df: DataFrame, ts: str, topic: str, width: str, slide: str | None = None,
    author: str | None = None, weight: str | None = None,
) -> DataFrame:
    """Mention counts per topic and window; state holds one row per open window.

    Authors are counted approximately: an exact count would keep them all.
    """
    moving = F.window(ts, f"{seconds(width)} seconds", f"{seconds(slide or width)} seconds")
    measures = [F.count(F.lit(1)).alias("n"), F.sum(F.col(weight) if weight else F.lit(1.0)).alias("weight")]
    if author:
        measures.append(F.approx_count_distinct(author).alias("authors"))
    return df.where(F.col(topic).isNotNull()).groupBy(
        moving.alias("window"), F.col(topic).alias("topic")
    ).agg(*measures)


def live_episodes(df: DataFrame, ts: str, topic: str, gap: str) -> DataFrame:
    """Episodes of a topic, closed once the watermark passes their end."""
    quiet = F.session_window(ts, f"{seconds(gap)} seconds")
    grouped = df.where(F.col(topic).isNotNull()).groupBy(quiet.alias("w"), F.col(topic).alias("topic"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(
        "topic", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n"
    )


def start(
    df: DataFrame, progress: str, path: str | None = None, each_batch=None, trigger: dict | None = None
) -> StreamingQuery:
    """Start a live run and give its query back.

    `progress` is the folder that remembers what has been processed: a run that
    names it again goes on where the last one ended, with its state. `trigger` is
    what `DataStreamWriter.trigger` takes; without it the run ends after all files
    landed so far. Results go to the function `each_batch` (batch, batch_id), or are
    appended to a Parquet table at `path`.
    """
    _count_late(df.sparkSession)
    writer = df.writeStream.option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True}))
    if each_batch:
        return writer.foreachBatch(each_batch).start()
    return writer.outputMode("append").format("parquet").option("path", path).start()


class LateRows(StreamingQueryListener):
    """Adds up, per run, the rows that stateful operators dropped as too late; a query itself remembers its last 100 batches only."""

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        rows = sum(int(state.numRowsDroppedByWatermark) for state in event.progress.stateOperators)
        self.dropped[run] = self.dropped.get(run, 0) + rows
        self.batches[run] = int(event.progress.batchId)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


_late: dict[str, LateRows] = {}


def _count_late(spark: SparkSession) -> None:
    app = spark.sparkContext.applicationId
    if app not in _late:
        _late[app] = LateRows()
        spark.streams.addListener(_late[app])


def dropped_late(query: StreamingQuery, wait: float = 30.0) -> int:
    """Rows of this run that came after their window had closed, over all its batches and stateful operators.

    Counts arrive beside the run; up to `wait` seconds are spent on those of its last batch.
    """
    counts = _late[SparkSession.getActiveSession().sparkContext.applicationId]
    run, last, until = str(query.runId), query.lastProgress, time.monotonic() + wait
    while last is not None and counts.batches.get(run, -1) < int(last["batchId"]) and time.monotonic() < until:
        time.sleep(0.05)
    return counts.dropped.get(run, 0)


CLOCK = "seen timestamp"


def keep_late(df: DataFrame, ts: str, delay: str, width: str, folder: str, progress: str | None = None) -> str:
    """Part a stream into `timely` and `late` rows under `folder`; gives the folder back.

    A row is late if its window of `width` had closed before its batch began: its end lies `delay`
    or more before the newest time of earlier batches, which `clock` keeps from batch to batch. Each has a
    folder per batch, so a repeated batch replaces itself. Rows without a time are timely.
    """
    root = folder.rstrip("/")

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut(batch)
        before = None
        if batch_id:
            before = spark.read.schema(CLOCK).parquet(f"{root}/clock/batch={batch_id - 1}").first()["seen"]
        at = F.col(ts).cast("timestamp")
        newest = batch.agg(F.max(at).alias("seen")).select(F.greatest("seen", F.lit(before).cast("timestamp")).alias("seen"))
        write_batch(newest, f"{root}/clock", batch_id)
        end = F.window(at, f"{seconds(width)} seconds")["end"]
        closed = F.lit(False)
        if before is not None:
            closed = F.coalesce(end <= F.lit(before).cast("timestamp") - F.expr(f"interval {seconds(delay)} seconds"), F.lit(False))
        marked = batch.withColumn("_late", closed) if before is None else batch.where(F.col(ts).isNotNull()).withColumn("_late", closed).unionByName(
            batch.where(F.col(ts).isNull()).withColumn("_late", F.lit(False)))
        write_batch(marked.where("_late").drop("_late"), f"{root}/late", batch_id)
        write_batch(marked.where("not _late").drop("_late"), f"{root}/timely", batch_id)

    return run_available(df, folder, each, progress)


def live_scores(df: DataFrame, model: Bayes, id: str, text: str, path: str, progress: str | None = None) -> str:
    """Write the scores of a trained model for each batch of mentions, as `score_bayes` gives them; a folder per batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(score_bayes(model, batch, id, text), path, batch_id)

    return run_available(df, path, each, progress)


def run_available(df: DataFrame, path: str | None = None, each_batch=None, progress: str | None = None) -> str:
    """Process all files landed so far, then stop. Returns the output folder.

    Without `progress` each call is a run of its own that reads everything anew
    into a new folder; with it, a later call with the same `path` processes only
    what has landed since.
    """
    spark = df.sparkSession
    if progress and not path and not each_batch:
        raise ValueError("a run that goes on needs the path it writes to")
    path = path or fresh_path(spark, "live")
    start(df, progress or fresh_path(spark, "progress"), path, each_batch).awaitTermination()
    return path


def live_hot_topk(counts: DataFrame, k: int, path: str, progress: str | None = None) -> str:
    """Write the k leading topics of every window as soon as it has closed.

    Ranking is not allowed on a stream, so it runs on each batch of closed
    windows; a window closes in one batch, as a whole. Output is keyed by batch,
    so a repeated batch replaces itself.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        flat = batch.withColumn("bucket", F.col("window.start")).drop("window")
        write_batch(hot_topk(flat, k), path, batch_id)

    return run_available(counts, path, each, progress)


def append_committed(df: DataFrame, path: str, progress: str | None = None) -> str:
    """Append every batch to the committed table at `path`; `sinks.read_committed` reads it."""
    return run_available(df, path, lambda batch, batch_id: commit_batch(batch, path, batch_id), progress)
