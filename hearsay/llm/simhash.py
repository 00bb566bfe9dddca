"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints are linked if they differ in three bits or fewer. The
radius is odd, so it is split as 1 + 1 + 1: the 64 bits fall into four blocks of
16, each block is left out in turn, and of the other 48 bits every fingerprint
emits all variants within one bit (196 keys in all). Fingerprints that share a
key are within two bits outside the block left out. For every pair within three
bits one of these holds:

* a block holds exactly one differing bit: with that block left out the two meet
  in a shared variant, and their left-out blocks differ in one bit;
* no block does, and two bits differ: both lie in one block; with another block
  left out the two meet, and their left-out blocks are equal;
* no block does, and three bits differ: all lie in one block; with it left out
  both emit the same unchanged 48 bits.

So inside a key equal left-out blocks form stars, blocks one bit apart are tied
by one link, and only the unchanged 48 bits look further. All of that is linear
in the number of fingerprints of a key: large families of copies never become
pairs. The number of keys per fingerprint is fixed, and chance meetings on 48
bits and the block number stay rare for billions of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.skew import spread_join
from ..operators.grouping import components
from ..session import cut
from . import shingles
from .common import id_and_text, map_texts, partitions, tidy

WORDS = 3
SEED = 42
RADIUS = 3
BLOCKS, WIDTH = 4, 16
KEYS = BLOCKS * (64 - WIDTH + 1)
EMIT_ROWS = 1_000

_FLIPS = [np.array([sum(1 << b for b in c) for c in combinations(range(WIDTH), n)], dtype=np.int64) for n in (1, 3)]


def simhash(text: str | None, words: int = WORDS) -> int:
    """Unsigned fingerprint of a whole text; 0 without words."""
    found = ("" if text is None else text).encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    n = len(found) - words + 1
    runs = map(b" ".join, zip(*(found[i:] for i in range(words)))) if n > 0 else [b" ".join(found)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(r, SEED) for r in runs]), dtype=np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[start:start + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, fp) of every row, fp as signed 64 bits; a null or wordless text has 0."""
    def make():
        return lambda texts: {"fp": np.array([simhash(t, words) for t in texts], dtype=np.uint64).view(np.int64)}

    return map_texts(id_and_text(docs, id, text), make, "fp bigint")


def split(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(the other 48 bits closed up, the block left out)."""
    values = values.view(np.uint64)
    low, width = np.uint64(block * WIDTH), np.uint64(WIDTH)
    below = values & ((np.uint64(1) << low) - np.uint64(1))
    above = (values >> low) >> width
    return (above << low) | below, ((values >> low) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)


def ball(values: np.ndarray) -> np.ndarray:
    """(fingerprints, 196) keys: the number of the block left out, then a variant of the other bits."""
    flips = np.concatenate([[0], 1 << np.arange(64 - WIDTH)]).astype(np.uint64)
    out = [((split(values, b)[0][:, None] ^ flips[None, :]) | np.uint64(b << (64 - WIDTH))) for b in range(BLOCKS)]
    return np.concatenate(out, axis=1).view(np.int64)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for start in range(0, len(values), EMIT_ROWS):
            some = values[start:start + EMIT_ROWS]
            keys = ball(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(some, keys.shape[1]))], names=["key", "fp"])


def _tie(left: np.ndarray, least: np.ndarray, flips: np.ndarray) -> list[np.ndarray]:
    """Links between the heads of left-out blocks (sorted, distinct) that differ by one of the flips."""
    links = []
    for flip in flips:
        other = left ^ flip
        place = np.minimum(np.searchsorted(left, other), len(left) - 1)
        hit = (left[place] == other) & (left < other)
        if hit.any():
            links.append(np.stack([least[hit], least[place[hit]]], axis=1))
    return links


def link_key(key: int, values: np.ndarray) -> np.ndarray:
    """True links inside one key that connect whatever the key has to connect; linear in the number of values."""
    block = (key >> (64 - WIDTH)) & (BLOCKS - 1)
    rest, left = split(values, block)
    order = np.lexsort((values, left))
    values, left, rest = values[order], left[order], rest[order]
    first = np.concatenate([[True], left[1:] != left[:-1]])
    heads = values[first]
    head_of = heads[np.cumsum(first) - 1]
    links = [np.stack([values[~first], head_of[~first]], axis=1)]
    links += _tie(left[first], heads, _FLIPS[0])
    same = rest == np.uint64(key & ((1 << (64 - WIDTH)) - 1))  # the unchanged ones; distinct blocks among them
    if same.sum() > 1:
        links += _tie(left[same], values[same], _FLIPS[1])
    return np.concatenate(links)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> links; a key's fingerprints may span batches."""
    held_keys, held = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links_of(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        found = [np.stack([values[two], values[two + 1]], axis=1)]
        found += [link_key(int(keys[s]), values[s:s + n]) for s, n in zip(starts[sizes > 2], sizes[sizes > 2])]
        pairs = np.concatenate(found)
        near = np.bitwise_count((pairs[:, 0] ^ pairs[:, 1]).view(np.uint64)) <= RADIUS
        pairs = np.unique(np.sort(pairs[near], axis=1), axis=0)
        if not len(pairs):
            return None
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([held_keys, batch.column(0).to_numpy(zero_copy_only=False)])
        values = np.concatenate([held, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(keys):
            continue
        edge = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
        held_keys, held = keys[edge:], values[edge:]
        if edge and (out := links_of(keys[:edge], values[:edge])) is not None:
            yield out
    if len(held_keys) and (out := links_of(held_keys, held)) is not None:
        yield out


def near_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links within three bits that connect all such pairs of the distinct fingerprints in `fp`."""
    emitted = distinct.select("fp").mapInArrow(tidy(_emit), "key bigint, fp bigint")
    met = emitted.repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    return met.mapInArrow(tidy(_meet), "a bigint, b bigint").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def keyed_fingerprints(docs: DataFrame, words: int, id: str, text: str) -> DataFrame:
    """(_id, fp, h, keys, x) of every row: also the hash of its words, the MinHash keys of its shingles and the hash of its text as it is."""
    def make():
        def of(text):  # one text at a time, as words take many times its size
            found = shingles.words_of(text)
            return simhash(text, words), shingles.text_hash(found), shingles.band_keys(shingles.shingle_set(found))

        def work(texts):
            prints, names, keys = zip(*map(of, texts)) if texts else ((), (), ())
            return {"fp": np.array(prints, dtype=np.uint64).view(np.int64), "h": np.array(names, dtype=np.uint64).view(np.int64), "keys": list(keys)}
        return work

    rows = id_and_text(docs, id, text).withColumn("x", F.xxhash64("_text"))
    return map_texts(rows, make, "fp bigint, h bigint, keys binary", "x bigint")


def near_groups(
    docs: DataFrame, words: int = WORDS, id: str = "doc_id", text: str = "text", alike: float | None = None,
) -> DataFrame:
    """(id, fp, component_id): one row per row; component_id is the smallest id reachable over links.

    Links are fingerprints within three bits and, with `alike`, texts whose five-word
    shingles have at least that Jaccard similarity. Equal fingerprints are one node, so
    copies of one text cost one row each. Null and wordless texts share fingerprint
    zero. A row with a null id keeps its place in the component, whose id is the
    smallest id that is not null (null if there is none). Repeated rows come out
    repeated. An empty table gives an empty result.
    """
    printed = cut(fingerprints(docs, words, id, text) if alike is None else keyed_fingerprints(docs, words, id, text))
    groups = cut(printed.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("least")))
    links = cut(near_links(groups))
    if alike is not None:
        keyed = cut(printed.groupBy("h").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min("x").alias("x")))
        near = components(links, "a", "b").select(F.col("id").alias("fp"), F.col("event_id").alias("label"))
        tied = keyed.join(near, "fp", "left").select("h", F.coalesce("label", "fp").alias("label"))
        heads = tied.groupBy("label").agg(F.min("h").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
        known = cut(tied.join(heads, "label").select("a", F.col("h").alias("b")).where("a <> b"))
        found = shingles.alike_links(keyed, id_and_text(docs, id, text), known, alike)
        print_of = keyed.select("h", "fp")
        named = found.join(print_of.toDF("a", "x"), "a").join(print_of.toDF("b", "y"), "b")
        links = links.unionByName(named.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))
        links = cut(links)
    labels = components(links, "a", "b").select(F.col("id").alias("fp"), F.col("event_id").alias("label"))
    linked = groups.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    names = linked.groupBy("label").agg(F.min("least").alias("component_id"), F.sum("n").alias("_rows"))
    shared = cut(
        linked.join(names, "label").where("_rows > 1").select("fp", "n", "component_id")
    )
    found = spread_join(
        printed.select("_id", "fp"), shared.select("fp", "component_id"), "fp", F.coalesce("_id", F.lit(0)), shared.select("fp", "n"), how="left"
    )
    return found.select(F.col("_id").alias(id), "fp", F.coalesce("component_id", "_id").alias("component_id"))


def first_of_groups(
    docs: DataFrame, words: int = WORDS, id: str = "doc_id", text: str = "text", alike: float | None = None,
) -> DataFrame:
    """The rows of `docs` that stay: of each group the row of its smallest id.

    Of several rows of that id the one of the smallest text stays. Rows of a null
    id stay only if their group has no other id, one for each fingerprint.
    """
    groups = near_groups(docs, words, id, text, alike)
    own = groups.where(F.col(id) == F.col("component_id")).select(F.col(id).alias("_kept")).distinct()
    lone = groups.where(F.col(id).isNull() & F.col("component_id").isNull()).select("fp").distinct()

    @F.pandas_udf("bigint")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    def one_each(rows: DataFrame, by: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("_text").asc_nulls_first()))
        return rows.withColumn("_place", place).where("_place = 1").select("_row.*")

    # A row travels as one column, so its own names cannot clash with those used here.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    named = one_each(rows.join(own, F.col("_id") == F.col("_kept"), "left_semi"), "_id")
    nameless = rows.where(F.col("_id").isNull()).withColumn("_print", print_of(F.col("_text")))
    return named.unionByName(one_each(nameless.join(lone, F.col("_print") == F.col("fp"), "left_semi"), "_print"))
