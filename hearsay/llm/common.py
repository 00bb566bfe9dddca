"""What several operators of this subpackage share: session limits, label samples, ordered chunks, logistic fits."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import prepare

# Rows and bytes of one Arrow batch: a Python worker holds a few batches, whatever the texts are like.
BATCH_ROWS = 2_000
BATCH_BYTES = 1 << 20
# Documents of one ordered chunk, the unit that one task walks through in doc_id order.
CHUNK_ROWS = 4_000


def ready(spark: SparkSession) -> SparkSession:
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _text): only what an operator reads, so other columns cannot clash with its own."""
    return docs.select(F.col(id).cast("bigint").alias("_id"), F.col(text).cast("string").alias("_text"))


def release() -> None:
    """Give back what a task no longer needs: a Python worker lives on for other tasks, with all it once took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, which turns the batches of a task into others, and `release` after its last."""
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return tidied


def map_texts(
    rows: DataFrame, make: Callable[[], Callable[[list[str]], dict]], columns: str, along: str = "",
) -> DataFrame:
    """(_id, columns) of each row of (_id, _text), by a function on whole texts made once per task.

    Null texts come as empty. Ids pass through untouched, null or not, and so do the columns named in `along`.
    """
    passed = to_arrow_schema(StructType.fromDDL(along)) if along else []
    schema = pa.schema([("_id", pa.int64()), *to_arrow_schema(StructType.fromDDL(columns)), *passed])
    carried = [f.name for f in passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("_text").to_pylist()]
            kept = {name: batch.column(name) for name in carried}
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), **work(texts), **kept}, schema=schema)

    return rows.select("_id", "_text", *carried).mapInArrow(tidy(run), ", ".join(filter(None, ["_id bigint", columns, along])))


def fold(id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(id.cast("string")) % folds


def label_sample(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column,
    per_class: int, most_chars: int, id: str = "doc_id", text: str = "text",
) -> tuple[list[tuple[str, int]], float]:
    """([(text, label)], share of label 1): a bounded sample of labelled rows outside the held-out fold.

    At most `per_class` rows of either label, in the order of a hash of their id, as
    long as their whole texts sum up to `most_chars` characters (a row that would
    exceed them is passed over): the bounds of what reaches the driver, for fitting only.
    `held_out` is a condition on the column `_id`. Rows with null id, null label or another
    label than 0 and 1 teach nothing; of several labels of an id the larger counts, of several
    texts the least.
    """
    known = (
        labels.select(F.col(id).cast("bigint").alias("_id"), F.col(label).cast("int").alias("_label"))
        .where("_id is not null and _label in (0, 1)").where(~held_out)
        .groupBy("_id").agg(F.max("_label").alias("_label"))
    )
    sizes = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return [], float(sum(k for k in sizes)) if sizes else 0.5
    spark, picked = docs.sparkSession, []
    for value in (0, 1):
        first = known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked += [(r["_id"], value) for r in first.select("_id").collect()]

    def of(ids: list[tuple[int, int]]) -> DataFrame:
        chosen = F.broadcast(spark.createDataFrame(ids, "_id bigint, _label int"))
        rows = id_and_text(docs, id, text).join(chosen, "_id")
        return rows.select("_id", "_label", F.coalesce("_text", F.lit("")).alias("_text"))

    lengths = {(r["_id"], r["_label"]): r["n"] for r in of(picked).groupBy("_id", "_label").agg(F.max(F.length("_text")).alias("n")).collect()}
    fit, left = [], {0: most_chars, 1: most_chars}
    for key in sorted(lengths, key=lambda k: (hash_of(k[0]), k[0])):
        if lengths[key] <= left[key[1]]:
            left[key[1]] -= lengths[key]
            fit.append(key)
    if not fit:
        return [], sizes[1] / (sizes[0] + sizes[1])
    rows = of(fit).groupBy("_id", "_label").agg(F.min("_text").alias("_text")).collect()
    rows.sort(key=lambda r: (hash_of(r["_id"]), r["_id"]))
    return [(r["_text"], r["_label"]) for r in rows], sizes[1] / (sizes[0] + sizes[1])


def hash_of(value: int) -> int:
    """A fixed scramble of an id, for orders that do not follow the ids."""
    x = (value * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF


def class_weights(y: np.ndarray, share: float) -> np.ndarray:
    """Weights that give a sample the class shares of all labelled rows."""
    ones = y.mean()
    return np.where(y == 1, share / ones, (1 - share) / (1 - ones))


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps, halved until the loss falls. `x` has its constant column."""
    def loss(w):
        z = x @ w
        return float(np.sum(weight * (np.logaddexp(0, z) - y * z)) + 0.5 * ridge * w @ w)

    w, now = np.zeros(x.shape[1]), None
    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, abs(before)):
            break
    return w


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def ordered_chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, list[int]]:
    """(rows with `_key` and `_chunk`, starts): `rows` by `_id` cut into runs of about `chunk_rows`.

    There are no more than eight runs per shuffle partition; beyond that they get longer.
    Only the id column is read for the cuts, so nothing wide is sorted or shuffled
    here. A chunk is the part of the ids from one start up to the next; the number
    of starts follows the number of rows. Rows of a null id come first, with the
    least key; rows of one id are always in one chunk.
    """
    least = -(1 << 63)
    keyed = rows.withColumn("_key", F.coalesce("_id", F.lit(least)))
    n = keyed.count()
    pieces = max(1, min(-(-n // chunk_rows), 8 * partitions(rows.sparkSession)))
    if pieces == 1:
        starts = [least]
    else:
        shares = [i / pieces for i in range(1, pieces)]
        cuts = keyed.agg(F.percentile_approx("_key", shares, max(10_000, 4 * pieces)).alias("c")).first()["c"]
        starts = sorted({least, *cuts})
    return keyed.withColumn("_chunk", chunk_of(F.col("_key"), starts)), starts


def chunk_of(key: Column, starts: list[int]) -> Column:
    """Position of the last start that is not above the key, by a binary search in the JVM."""
    if len(starts) == 1:
        return F.lit(0)
    marks = ",".join(f"{s}L" if s > -(1 << 63) else "bigint('-9223372036854775808')" for s in starts)
    array = F.expr(f"array({marks})")
    steps = F.array(*[F.lit(1 << s) for s in range(len(starts).bit_length() - 1, -1, -1)])

    def search(at, step):
        further = at + step
        fits = (further < len(starts)) & (F.get(array, further) <= key)
        return F.when(fits, further).otherwise(at)

    return F.aggregate(steps, F.lit(0), search)
