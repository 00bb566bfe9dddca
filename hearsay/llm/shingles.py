"""Near copies by the Jaccard similarity of their word shingles: MinHash candidates, exact verdicts.

A text is the set of its 64-bit shingle hashes. It gets BANDS keys of ROWS least
values each; two texts of similarity s share a key with the chance
1 - (1 - s ** ROWS) ** BANDS, which misses 3 in a million at 0.8 and fewer above.
What shares a key is compared by its whole sets, so nothing is linked by chance.

All pairs of a large family are not needed, only links that connect it: first every
text of a key is compared to the least one of the key. Texts of keys that this leaves in
several components are open. They are joined on their shingles by the prefix filter:
two sets of similarity s share one of the rarest n - ceil(s * n) + 1 shingles of either,
and where they first meet, what lies behind bounds what they can have in common. A text
that has met nothing in its first ninth (at 0.8) only fits one that did, so a crowd of texts
each of which has that much of its own is never paired at all. First one pair is compared
for any two components that meet in a shingle, then, of those still apart, all that fit. Pairs
whose sketches (one byte of each least value) agree in fewer than SKETCHED of all
places are left out: at 0.8 that is more than four standard deviations away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.skew import spread_join
from ..operators.grouping import components
from ..session import cut
from .common import partitions, tidy

WORDS = 5
ALIKE = 0.8
SEED = 42
ROWS, BANDS = 5, 32
PIECE = 256
SKETCHED = 0.7
PLACES = 320  # least values of the sketch; the first ROWS * BANDS of them make the keys

_SOURCE = np.random.default_rng(SEED)
_TIMES = _SOURCE.integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _SOURCE.integers(0, 1 << 63, PLACES, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return ("" if text is None else text).encode("utf-8", "replace").lower().split()


def text_hash(found: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(found), SEED)


def shingle_set(found: list[bytes], words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of words; a shorter text is one run, a wordless one is empty."""
    if not found:
        return np.zeros(0, dtype=np.uint64)
    n = len(found) - words + 1
    runs = map(b" ".join, zip(*(found[i:] for i in range(words)))) if n > 0 else [b" ".join(found)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(r, SEED) for r in runs], dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> bytes:
    """BANDS keys of 64 bits, then the sketch; nothing for an empty set."""
    if not len(hashes):
        return b""
    least = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), PIECE):
        np.minimum(least, (hashes[None, start:start + PIECE] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    held, width = least.tobytes(), ROWS * 8
    return np.array(
        [xxhash.xxh64_intdigest(held[b * width:(b + 1) * width], b) for b in range(BANDS)], dtype=np.uint64
    ).tobytes() + (least >> np.uint64(24)).astype(np.uint8).tobytes()


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False)
        keys = [np.frombuffer(k[:8 * BANDS], dtype=np.int64) for k in batch.column(1).to_pylist()]
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.repeat(own, [len(k) for k in keys]))], names=["key", "h"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and text -> (key, its least text, each other one); a key may span batches."""
    last, head = None, None
    for batch in batches:
        keys, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(keys):
            continue
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        heads = own[first].copy()
        if last is not None and keys[0] == last:
            heads[0] = head
        least = heads[np.cumsum(first) - 1]
        last, head = keys[-1], least[-1]
        other = least != own
        yield pa.RecordBatch.from_arrays([pa.array(keys[other]), pa.array(least[other]), pa.array(own[other])], names=["key", "a", "b"])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.frombuffer(raw, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(found), h)), pa.array(np.full(len(found), len(found), dtype=np.int32)), pa.array(found)],
                names=["h", "n", "shingle"])


def rare_shingles(sets: DataFrame, alike: float) -> DataFrame:
    """(shingle, h, n, most, roomy) of the texts of (h, hashes): the rarest shingles of each that another has too.

    `most` is the largest set that the text can be so similar to if it meets it first
    in this shingle; the row is roomy if that is as large as the text itself.
    """
    rows = cut(sets.mapInArrow(tidy(_each_shingle), "h bigint, n int, shingle bigint"))
    shared = cut(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    known = spread_join(rows, shared.select("shingle", F.col("n").alias("df")), "shingle", F.col("h"), shared)
    common = known.groupBy("h", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("_common"))
    alone = F.col("n") - F.size("_common")
    length = F.col("n") - F.ceil(F.col("n") * F.lit(alike) - 1e-9).cast("int") + 1 - alone
    placed = common.select("h", "n", alone.alias("_alone"), F.posexplode(
        F.slice("_common", F.lit(1), F.greatest(F.least(length, F.size("_common")), F.lit(0)))).alias("_at", "_pair"))
    left = F.col("n") - F.col("_alone") - F.col("_at")
    most = F.floor(left * F.lit((1 + alike) / alike) - F.col("n") + 1e-6).cast("int")
    return placed.select(F.col("_pair.shingle").alias("shingle"), "h", "n", most.alias("most")).withColumn("roomy", F.col("most") >= F.col("n"))


def _meetings(rare: DataFrame) -> DataFrame:
    """(shingle, label, _label): components that meet in a shingle, the first with a roomy row there."""
    sides = rare.groupBy("shingle", "label").agg(F.max("roomy").alias("roomy"))
    open_ = sides.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.max("roomy").alias("roomy")).where("n > 1 and roomy")
    sides = cut(sides.join(open_.select("shingle"), "shingle"))
    other = sides.select("shingle", F.col("label").alias("_label"), F.col("roomy").alias("_roomy"))
    # Of two roomy sides the smaller label comes first, so no two rows say the same.
    return sides.where("roomy").join(other, "shingle").where("label < _label or (label <> _label and not _roomy)").select("shingle", "label", "_label")


def _paired(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def one_each(rare: DataFrame) -> DataFrame:
    """(a, b): for any two components that meet in a shingle, the largest sets of either that may fit there."""
    place = F.struct("most", "h", "n")
    tops = rare.groupBy("shingle", "label").agg(F.max(place).alias("_top"))
    met = _meetings(rare).join(tops, ["shingle", "label"]).join(
        tops.select("shingle", F.col("label").alias("_label"), F.col("_top").alias("_other")), ["shingle", "_label"])
    one = met.groupBy("label", "_label").agg(F.min(F.struct("_top", "_other")).alias("_pair"))
    return one.select(*_paired("_pair._top.h", "_pair._other.h")).distinct()


def all_fitting(rare: DataFrame) -> DataFrame:
    """(a, b): all texts of two components that meet in a shingle and may be alike."""
    other = rare.select("shingle", F.col("label").alias("_label"), F.col("h").alias("_h"), F.col("n").alias("_n"), F.col("most").alias("_most"))
    # A text that fits no text of the other component there is not met with it.
    fits = rare.groupBy("shingle", F.col("label").alias("_label")).agg(F.min("n").alias("_least"), F.max("most").alias("_reach"))
    met = _meetings(rare).join(fits, ["shingle", "_label"]).join(rare.drop("roomy"), ["shingle", "label"]).where("n <= _reach and _least <= most")
    return met.join(other, ["shingle", "_label"]).where("n <= _most and _n <= most").select(*_paired("h", "_h")).distinct()


def likely(pairs: DataFrame, keyed: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches agree in SKETCHED of all places."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(k[8 * BANDS:] for k in batch.column(i).to_pylist()), dtype=np.uint8).reshape(len(batch), -1) for i in (2, 3))
            same = (one == two).mean(axis=1) >= SKETCHED if len(batch) else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    counts = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    second = pairs.join(keyed.select(F.col("h").alias("b"), F.col("keys").alias("_two")), "b")
    met = spread_join(second, keyed.select(F.col("h").alias("a"), F.col("keys").alias("_one")), "a", F.col("b"), counts)
    return met.select("a", "b", "_one", "_two").mapInArrow(tidy(compare), "a bigint, b bigint")


def text_sets(texts: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(h, hashes) of the wanted texts of `_text`, one row each.

    `wanted` has (h, x): a text's own name and the hash by which it is found without reading its words.
    """
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sets = [], []
            for text in batch.column(0).to_pylist():
                found = words_of(text)
                names.append(text_hash(found))
                sets.append(shingle_set(found, words).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(names, dtype=np.uint64).view(np.int64)), pa.array(sets, pa.binary())], names=["h", "hashes"])

    met = texts.select("_text", F.xxhash64("_text").alias("x")).join(wanted.select("x").distinct(), "x", "left_semi").drop("x")
    # Another text of the same hash may come along; its name is not wanted.
    found = met.mapInArrow(tidy(shingle), "h bigint, hashes binary")
    return found.join(wanted.select("h"), "h", "left_semi").dropDuplicates(["h"])


def _verified(pairs: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least so similar."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(one.as_py(), dtype=np.uint64), np.frombuffer(two.as_py(), dtype=np.uint64)
                both = 0
                if min(len(x), len(y)) >= alike * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(both > 0 and both >= alike * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    counts = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    second = pairs.join(sets.select(F.col("h").alias("b"), F.col("hashes").alias("_two")), "b")
    met = spread_join(second, sets.select(F.col("h").alias("a"), F.col("hashes").alias("_one")), "a", F.col("b"), counts)
    return cut(met.select("a", "b", "_one", "_two").mapInArrow(tidy(compare), "a bigint, b bigint"))


def alike_links(
    keyed: DataFrame, texts: DataFrame, known: DataFrame, alike: float = ALIKE, words: int = WORDS,
) -> DataFrame:
    """(a, b): links that connect all texts of (h, x, keys) that share a key and are at least so similar.

    Texts that the links (a, b) of `known` connect are not compared again.
    """
    spark = keyed.sparkSession
    keys = keyed.select("h", "keys").mapInArrow(tidy(_explode), "key bigint, h bigint")
    met = cut(keys.repartition(partitions(spark), "key").sortWithinPartitions("key", "h").mapInArrow(tidy(_stars), "key bigint, a bigint, b bigint"))
    stars = cut(met.select("a", "b").distinct())
    wanted = stars.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    sets = cut(text_sets(texts, cut(keyed.select("h", "x").join(wanted, "h")), words))
    links = known.unionByName(_verified(stars, sets, alike))
    several = cut(met.select("key", F.col("b").alias("h")).unionByName(met.select("key", F.col("a").alias("h")).distinct()))
    labels = _labels(links)
    labelled = several.join(labels, "h", "left").withColumn("label", F.coalesce("label", "h"))
    # Two texts of a key have been compared already.
    open_ = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("x"), F.max("label").alias("y"))
    texts_open = cut(labelled.join(open_.where("n > 2 and x <> y").select("key"), "key", "left_semi").select("h").distinct())
    if texts_open.isEmpty():
        return links
    rare = cut(rare_shingles(sets.join(texts_open, "h", "left_semi"), alike))
    sketches = keyed.join(texts_open, "h", "left_semi").select("h", "keys")
    tested = stars
    for choose in (one_each, all_fitting):
        now = cut(rare.join(labels, "h", "left").withColumn("label", F.coalesce("label", "h")))
        pairs = cut(choose(now).join(tested, ["a", "b"], "left_anti"))
        found = _verified(cut(likely(pairs, sketches)), sets, alike)
        tested, links = tested.unionByName(pairs), links.unionByName(found)
        labels = _labels(links)
    return links


def _labels(links: DataFrame) -> DataFrame:
    return cut(components(links, "a", "b").select(F.col("id").alias("h"), F.col("event_id").alias("label")))
