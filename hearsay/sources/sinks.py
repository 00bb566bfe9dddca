"""Writing event tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_events(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """Parquet partitioned by `by`; an overwrite replaces only the partitions it touches.

    The rebalance hint gathers each partition value into few files and lets AQE
    split a value that holds very many rows.
    """
    (
        df.hint("rebalance", by).write.mode(mode)
        .option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    )


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch, so that a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


# A committed table keeps its rows in folders under `data`; only those that a commit names are read.
COMMITS = "folder string, batch int"
BASES = "folder string, upto int"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _entries(spark: SparkSession, path: str, kind: str, schema: str) -> list:
    return spark.read.schema(schema).parquet(f"{path}/{kind}").collect() if _exists(spark, f"{path}/{kind}") else []


def commit_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Add one micro-batch: first its rows in a new folder, then the commit that names it.

    A batch that is killed before its commit leaves a folder that nobody reads; run again, it
    writes another and replaces its commit, so no row is read twice. A batch that a
    compaction has taken in already is not added again.
    """
    path = path.rstrip("/")
    spark = df.sparkSession
    if any(b["upto"] >= batch_id for b in _entries(spark, path, "bases", BASES)):
        return
    folder = f"part-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/data/{folder}")
    spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")


def committed_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders that hold the table now: the last compaction and the batches after it, one each."""
    path = path.rstrip("/")
    bases = sorted(_entries(spark, path, "bases", BASES), key=lambda b: b["upto"])[-1:]
    upto = bases[0]["upto"] if bases else -1
    later = sorted((c for c in _entries(spark, path, "commits", COMMITS) if c["batch"] > upto), key=lambda c: c["batch"])
    return [b["folder"] for b in bases] + [c["folder"] for c in later]


def read_committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    folders = committed_folders(spark, path)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/data/{f}" for f in folders])


def compact(spark: SparkSession, path: str, schema: StructType | str, upto: int, files: int = 1) -> None:
    """Put all batches up to `upto` into one folder of `files` files.

    Readers change over when the entry that names the folder is written. The folders of before
    stay for readers that have begun; `superseded` names them.
    """
    path = path.rstrip("/")
    bases = sorted(_entries(spark, path, "bases", BASES), key=lambda b: b["upto"])[-1:]
    known = bases[0]["upto"] if bases else -1
    if upto <= known:
        return
    taken = [b["folder"] for b in bases] + [
        c["folder"] for c in _entries(spark, path, "commits", COMMITS) if known < c["batch"] <= upto]
    if not taken:
        return
    folder = f"base-{uuid.uuid4().hex}"
    rows = spark.read.schema(schema).parquet(*[f"{path}/data/{f}" for f in taken])
    rows.repartition(files).write.parquet(f"{path}/data/{folder}")
    spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/bases/upto={upto}")


def superseded(spark: SparkSession, path: str) -> list[str]:
    """Folders under `data` that no reader of now needs: taken in by a compaction, or of a batch that was run again or killed."""
    path = path.rstrip("/")
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    held = {f.getPath().getName() for f in files.listStatus(root)} if files.exists(root) else set()
    return sorted(held - set(committed_folders(spark, path)))
