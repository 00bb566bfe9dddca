"""Document fingerprints by winnowing.

Hashes of all k-grams of characters are rolled over a text; of every window of w
hashes in a row the least is kept, of equal ones the rightmost, with its position.
Any run of k + w - 1 characters that two texts share puts at least one common hash
into both fingerprints; nothing shorter than k characters is ever matched.

A fingerprint is a string of ten hex digits per kept k-gram: eight of its hash, two
of its distance from the kept one before it (of the first: from the start). Windows
overlap, so distances stay below w.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import code_points, id_and_text, ordered_chunks, partitions

K = 16
WINDOW = 32

_STEP, _MIX = 1099511628211, np.uint64(0x9E3779B97F4A7C15)
_RIGHT = np.uint64(0xFFFFFFFF)


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit rolling hashes of all runs of k characters; of a shorter text, the one of the whole."""
    k = min(k, len(points))
    if k == 0:
        return np.zeros(0, dtype=np.uint64)
    single = points.astype(np.uint64) * _MIX
    h, width, step = single, 1, _STEP
    while width * 2 <= k:
        h, width, step = h[:-width] * np.uint64(step) + h[width:], width * 2, step * step % (1 << 64)
    for i in range(width, k):
        h = h[:-1] * np.uint64(_STEP) + single[i:]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the kept k-grams, in order of position."""
    hashes = gram_hashes(points, k)
    n = len(hashes)
    if n == 0:
        return hashes.astype(np.uint32), np.zeros(0, dtype=np.int64)
    # Least hash first; among equal hashes the rightmost position.
    ranked = (hashes << np.uint64(32)) | (_RIGHT - np.arange(n, dtype=np.uint64))
    span, size = ranked, 1
    reach = min(window, n)
    while size * 2 <= reach:
        span, size = np.minimum(span[:-size], span[size:]), size * 2
    if size < reach:
        rest = reach - size
        span = np.minimum(span[:-rest], span[rest:])
    kept = span[np.concatenate([[True], span[1:] != span[:-1]])]
    return (kept >> np.uint64(32)).astype(np.uint32), (_RIGHT - (kept & _RIGHT)).astype(np.int64)


def to_text(hashes: np.ndarray, positions: np.ndarray) -> str:
    rows = np.zeros((len(hashes), 5), dtype=np.uint8)
    rows[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    rows[:, 4] = np.diff(positions, prepend=0)
    return rows.tobytes().hex()


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a fingerprint."""
    rows = np.frombuffer(bytes.fromhex(fingerprint), dtype=np.uint8).reshape(-1, 5)
    hashes = np.ascontiguousarray(rows[:, :4]).view(">u4").ravel().astype(np.uint32)
    return hashes, np.cumsum(rows[:, 4].astype(np.int64))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of distinct, sorted hashes; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many of the next text, or all of it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprint_documents(
    docs: DataFrame, k: int = K, window: int = WINDOW, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next row by ascending id, of the last row the
    first. Rows of a null id come before all others, rows of one id in the order of
    their texts; a null text counts as empty, and an empty text has an empty
    fingerprint. `window` is at most 255. An empty table gives an empty result.

    Texts are dealt once, in chunks of ids; the first rows of a chunk also go to the
    chunk before it, so that each chunk sees the text that follows it.
    """
    if not 1 <= window <= 255:
        raise ValueError("window must be 1 to 255")
    spark = docs.sparkSession
    rows, starts = ordered_chunks(id_and_text(docs, id, text))
    first = rows.groupBy("_chunk").agg(F.min("_key").alias("_key")).orderBy("_chunk").collect()
    chunks = [r["_chunk"] for r in first]
    before = {r["_key"]: chunks[i - 1] for i, r in enumerate(first)}  # of the first chunk: the last
    if not before:
        before = {0: 0}
    # As many keys as chunks: a small table beside the documents, not a literal.
    heads = spark.createDataFrame(list(before.items()), "_key bigint, _before int")
    marked = rows.join(F.broadcast(heads), "_key", "left")
    places = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_chunk").alias("c"), F.lit(False).alias("copy")))).otherwise(
        F.array(F.struct(F.col("_chunk").alias("c"), F.lit(False).alias("copy")), F.struct(F.col("_before").alias("c"), F.lit(True).alias("copy"))))
    dealt = (
        marked.select("_id", "_key", "_text", F.explode(places).alias("_place"))
        .select(F.col("_place.c").alias("_chunk"), F.col("_place.copy").alias("_copy"), "_id", "_key", "_text")
        .repartition(partitions(spark), "_chunk")
        .sortWithinPartitions("_chunk", "_copy", "_key", F.col("_text").asc_nulls_first())
        .select("_chunk", "_copy", "_id", "_text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one is not known yet: chunk, id, text, hashes, distinct hashes, positions
        closed = None  # the chunk whose following text has been met

        def finish(row, following: str, near: np.ndarray):
            _, doc, own, hashes, distinct, positions = row
            changed = edited(own, following)
            if changed == own:
                their_hashes, their_positions = hashes, positions
            else:
                their_hashes, their_positions = winnow(code_points(changed), k, window)
            return (
                doc, len(own), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                to_text(hashes, positions), to_text(their_hashes, their_positions),
                likeness(distinct, np.unique(their_hashes)), likeness(distinct, near),
            )

        for batch in batches:
            out = []
            for chunk, copy, doc, raw in zip(*(batch.column(c).to_pylist() for c in ("_chunk", "_copy", "_id", "_text"))):
                if copy and chunk == closed:
                    continue  # another row of the id that follows
                own = "" if raw is None else raw
                hashes, positions = winnow(code_points(own), k, window)
                row = (chunk, doc, own, hashes, np.unique(hashes), positions)
                if held is not None:
                    out.append(finish(held, own, row[4]))
                held, closed = (None, chunk) if copy else (row, None)
            yield pa.RecordBatch.from_pydict({name: [row[k] for row in out] for k, name in enumerate(schema.names)}, schema=schema)

    columns = (
        "_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    schema = to_arrow_schema(StructType.fromDDL(columns))
    return dealt.mapInArrow(run, columns).withColumnRenamed("_id", id)
