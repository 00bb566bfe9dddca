"""Stupid-backoff language model scores of documents against the corpus.

The model is the corpus itself: counts of all n-grams of all documents, less those
of the document that is scored (leave-one-out), so nothing is scored by itself.

Relations, each partitioned by what it is joined on:

* blocks: documents of some megabytes, whatever the Arrow batches are like, with their words
  as codes and the hashes of the block's distinct words; written once, so a block never changes;
* n-grams: the distinct n-grams of each block with their counts in it, dealt by hash
  into buckets. A bucket sums them into the count table and joins the sums back to
  the n-grams asked for. An n-gram, however frequent, is one entry per block;
* answers: the corpus counts, dealt by block and joined to the blocks' n-grams, which
  are exploded there into the words of each document and summed per document.

Entries travel packed and compressed, many to a row: a bucket keeps 48 bits of a hash beside the
bits that chose the bucket, as steps from one key to the next, and there are as many buckets as the
corpus needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import fresh_path
from .common import id_and_text, partitions, tidy

ORDER = 2
BACKOFF = 0.4
# N-grams asked for per bucket, about.
BUCKET_ENTRIES = 1_000_000
# Bytes of the texts of a block, about, each row counted with some of its own; an n-gram is an entry in every block that has it.
BLOCK_BYTES = 4 << 20
ROW_BYTES = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCKS = "block bigint, n_words bigint, n_distinct bigint, doc_ids array<bigint>, lengths binary, codes binary, hashes binary"


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z in lower case."""
    return ("" if text is None else text).encode("utf-8", "replace").lower().split()


def squeeze(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on, mostly small: a width of 4 or 8 bytes, then all lowest bytes, all second ones and so on, compressed."""
    width = 4 if numbers.max(initial=0) < 1 << 32 else 8
    planes = np.ascontiguousarray(numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), dtype=np.uint8).reshape(raw[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{raw[0]}").ravel()


def _block(number: int, ids: list, texts: list[str | None]) -> pa.RecordBatch:
    split = [words_of(t) for t in texts]
    flat = np.array([w for words in split for w in words], dtype=object)
    codes, distinct = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), [])
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in distinct], dtype="<u8")
    row = {
        "block": [number], "n_words": [len(flat)], "n_distinct": [len(hashes)], "doc_ids": [ids],
        "lengths": [np.array([len(w) for w in split], dtype="<u4").tobytes()],
        "codes": [squeeze(codes)], "hashes": [hashes.tobytes()],
    }
    return pa.RecordBatch.from_pydict(row, schema=pa.schema([
        ("block", pa.int64()), ("n_words", pa.int64()), ("n_distinct", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.binary()), ("codes", pa.binary()), ("hashes", pa.binary())]))


def _blocks(most: int):
    """Texts -> blocks of at most `most` bytes of whole Arrow batches, at least one batch each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ids, texts, size, place = [], [], 0, 0
        for batch in batches:
            own = batch.column("_text").nbytes + ROW_BYTES * len(batch)
            if ids and size + own > most:
                yield _block((task << 32) + place, ids, texts)
                ids, texts, size, place = [], [], 0, place + 1
            ids += batch.column("_id").to_pylist()
            texts += batch.column("_text").to_pylist()
            size += own
        if ids:
            yield _block((task << 32) + place, ids, texts)

    return run


def grams_of(lengths: np.ndarray, codes: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level (positions, number of the n-gram ending there, first position of each number).

    An n-gram lies within one document. Numbers follow the codes alone, so any task
    that reads a block finds the same ones.
    """
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    where, number = np.arange(len(codes)), codes.astype(np.int64)
    levels = [(where, number, None)]
    last = number
    width = int(codes.max(initial=0)) + 1
    for n in range(2, order + 1):
        long = np.flatnonzero(inside >= n - 1)
        pairs = last[long - 1] * width + number[long]
        _, first, ids = np.unique(pairs, return_index=True, return_inverse=True)
        levels.append((long, ids, long[first]))
        last = np.full(len(codes), -1, dtype=np.int64)
        last[long] = ids
    return levels


def gram_hashes(levels, codes: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Hash of every n-gram by level and number."""
    out, at = [hashes.astype(np.uint64)], hashes.astype(np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    words = at
    for n, (_, _, first) in enumerate(levels[1:], start=2):
        h = (at[first - 1] * np.uint64(1099511628211)) ^ (words[first] + np.uint64(n)) * _MIX
        h = (h ^ (h >> np.uint64(31))) * _MIX
        out.append(h ^ (h >> np.uint64(29)))
        where, ids, _ = levels[n - 1]
        at = at.copy()
        at[where] = out[-1][ids]
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def keys_in(hashes: np.ndarray, of: np.ndarray, buckets: int) -> np.ndarray:
    """What a bucket keeps of its hashes, in their order: how far they lie behind its least, to 48 bits beside those of the bucket."""
    least = (np.arange(buckets, dtype=np.uint64) << np.uint64(32)) + np.uint64(buckets - 1)
    least = (least // np.uint64(buckets)) << np.uint64(32)
    return (hashes - least[of]) >> np.uint64(max(0, 17 - buckets.bit_length()))


def _asking(order: int, buckets: int):
    """Blocks -> (bucket, block, keys, counts): the block's distinct n-grams of all levels, by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, codes = np.frombuffer(row["lengths"], "<u4").astype(np.int64), unsqueeze(row["codes"])
                levels = grams_of(lengths, codes, order)
                by_level = gram_hashes(levels, codes, np.frombuffer(row["hashes"], "<u8"))
                counts = np.concatenate([np.bincount(ids, minlength=len(h)) for (_, ids, _), h in zip(levels, by_level)])
                hashes = np.concatenate(by_level)
                if not len(hashes):
                    continue
                sort = np.argsort(hashes, kind="stable")
                hashes, counts = hashes[sort], counts[sort]
                of = bucket_of(hashes, buckets)
                keys = keys_in(hashes, of, buckets)
                edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]]))
                rows = {
                    "bucket": of[edges[:-1]].astype(np.int32), "block": np.full(len(edges) - 1, row["block"]),
                    "keys": [squeeze(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(edges[:-1], edges[1:])],
                    "counts": [squeeze(counts[a:b]) for a, b in zip(edges[:-1], edges[1:])],
                }
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                    ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return run


def _count_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket -> (block, bucket, totals): corpus counts in the order they were asked for."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary())])
    held: list[dict] = []

    def answer() -> pa.RecordBatch:
        keys = [np.cumsum(unsqueeze(r["keys"]), dtype=np.uint64) for r in held]
        counts = np.concatenate([unsqueeze(r["counts"]) for r in held])
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        # Sums of whole numbers below 2^53 are exact.
        totals = np.bincount(place, weights=counts)[place].astype("<u8")
        edges = np.cumsum([0, *map(len, keys)])
        return pa.RecordBatch.from_pydict({
            "block": [r["block"] for r in held], "bucket": [r["bucket"] for r in held],
            "totals": [squeeze(totals[a:b]) for a, b in zip(edges[:-1], edges[1:])]}, schema=schema)

    for batch in batches:
        for row in batch.to_pylist():
            if held and row["bucket"] != held[0]["bucket"]:
                yield answer()
                held = []
            held.append(row)
    if held:
        yield answer()


def score_block(lengths, codes, hashes, totals: np.ndarray, n_corpus: int, order: int, backoff: float, leave_out: bool) -> np.ndarray:
    """Sum of log scores per document; `totals` are the corpus counts of the block's n-grams by hash."""
    levels = grams_of(lengths, codes, order)
    by_level = gram_hashes(levels, codes, hashes)
    sort = np.argsort(np.concatenate(by_level), kind="stable")
    known = np.zeros(len(sort), dtype=np.int64)
    known[sort] = totals
    doc = np.repeat(np.arange(len(lengths)), lengths)
    rest = n_corpus - (lengths if leave_out else 0 * lengths)
    starts = np.cumsum([0, *map(len, by_level)])
    counts = []  # by level: counts without the document at each position, 0 where no n-gram ends
    for (where, ids, _), a, b in zip(levels, starts[:-1], starts[1:]):
        others = known[a:b][ids]
        if leave_out and len(ids):
            _, place, own = np.unique(doc[where] * (b - a) + ids, return_inverse=True, return_counts=True)
            others = others - own[place]
        full = np.zeros(len(codes), dtype=np.int64)
        full[where] = others
        counts.append(full)
    total = rest[doc]
    score = np.log(np.where(counts[0] > 0, counts[0] / np.maximum(total, 1), 1.0 / (total + 1.0)))
    for n in range(1, order):
        seen = counts[n] > 0
        context = np.zeros(len(codes), dtype=np.int64)
        context[1:] = counts[n - 1][:-1]
        # Only where an n-gram of this length can end does the shorter one cost a step back.
        full_length = np.zeros(len(codes), dtype=bool)
        full_length[levels[n][0]] = True
        backed = score + np.where(full_length, np.log(backoff), 0.0)
        score = np.where(seen, np.log(np.maximum(counts[n], 1) / np.maximum(context, 1)), backed)
    return np.bincount(doc, weights=score, minlength=len(lengths))


def score_documents(
    docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, leave_out: bool = True,
    id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(id, n_words, log_score, mean_log_score) of every row, repeated rows each for itself.

    A word scores count(n-gram) / count(its context) of the longest n-gram seen in
    other documents, times `backoff` for each step to a shorter one; a word seen
    nowhere else counts as one of the corpus and itself. log_score is the sum of
    natural logarithms. A null or empty text has 0 words, log_score 0 and no mean.
    With `leave_out` off all counts include the document.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "blocks")
    id_and_text(docs, id, text).mapInArrow(tidy(_blocks(BLOCK_BYTES)), _BLOCKS).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    n_corpus, asked = blocks.agg(F.sum("n_words"), F.sum(F.col("n_distinct") + (order - 1) * F.col("n_words"))).first()
    n_corpus = n_corpus or 0
    buckets = max(partitions(spark), -(-(asked or 0) // BUCKET_ENTRIES))
    asking = blocks.select("block", "lengths", "codes", "hashes").mapInArrow(
        tidy(_asking(order, buckets)), "bucket int, block bigint, keys binary, counts binary")
    answers = (
        asking.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket")
        .mapInArrow(tidy(_count_table), "block bigint, bucket int, totals binary")
    )

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]  # a block is one row
        lengths, codes = np.frombuffer(row["lengths"], "<u4").astype(np.int64), unsqueeze(row["codes"])
        answers = found.sort_by("bucket").column("totals").to_pylist()
        totals = np.concatenate([np.zeros(0, np.int64), *(unsqueeze(a).astype(np.int64) for a in answers)])
        sums = score_block(lengths, codes, np.frombuffer(row["hashes"], "<u8"), totals, n_corpus, order, backoff, leave_out)
        return pa.table({"_id": pa.array(row["doc_ids"], pa.int64()), "n_words": pa.array(lengths), "log_score": pa.array(sums, pa.float64())})

    scored = (
        blocks.select("block", "doc_ids", "lengths", "codes", "hashes").groupBy("block").cogroup(answers.groupBy("block"))
        .applyInArrow(score, "_id bigint, n_words bigint, log_score double")
    )
    return scored.select(
        F.col("_id").alias(id), "n_words", "log_score", F.try_divide("log_score", "n_words").alias("mean_log_score"))
