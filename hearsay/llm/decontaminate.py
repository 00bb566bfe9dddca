"""Benchmark decontamination: passages of benchmark items in documents, up to a share of edits.

1. Windows of item size are laid where the q-gram lemma leaves room for an
   occurrence: with at most k edits, L - q + 1 - k*q of the item's q-grams stay, at
   starts no further apart than k. That loses nothing.
2. CGK embedding: a random walk reads a window and now and then repeats a
   character, so that strings of small edit distance agree in most places of their
   walks. Bit-sampling LSH compares a few random places per table; many tables
   over several walks reach the target recall.
3. What collides with the item in some table is verified by exact edit distance.

Items are the query set. They are taken in blocks of bounded size, each of which
goes to the workers whole; documents are read in place and never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import code_points, id_and_text, release, tidy

Q = 10
EDIT_SHARE = 0.08
MIN_CHARS = 40
BLOCK_CHARS = 2_000_000
WALKS = 8
SAMPLED = 4
# Share of equal places in two walks at the largest number of edits, and the recall asked of the tables.
LEAST_AGREEMENT = 0.5
TARGET_RECALL = 0.98
TABLES = math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - LEAST_AGREEMENT ** SAMPLED))

FIELDS = ("_id", "item_id", "start", "end", "edits")
HITS = "_id bigint, item_id bigint, start int, end int, edits int"

_SPACE = {9: 32, 10: 32, 11: 32, 12: 32, 13: 32}
_STEP, _MIX = np.uint64(1099511628211), np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> str:
    """Lower case, white space as spaces; every character keeps its place."""
    return ("" if text is None else text).replace("İ", "i").lower().translate(_SPACE)


def gram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """Rolling hashes of all runs of q characters."""
    if len(points) < q:
        return np.zeros(0, dtype=np.uint64)
    h, width, step = points.astype(np.uint64) * _MIX, 1, int(_STEP)
    while width * 2 <= q:
        h, width, step = h[:-width] * np.uint64(step) + h[width:], width * 2, step * step & 0xFFFFFFFFFFFFFFFF
    for i in range(width, q):
        h = h[:-1] * _STEP + points[i:].astype(np.uint64) * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX


def edits_allowed(n: int, share: float = EDIT_SHARE) -> int:
    return int(share * n)


def best_end(pattern: str, text: str) -> tuple[int, int]:
    """(least edits of `pattern` against a part of `text`, where that part ends): bit-parallel, exact."""
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    up, down, now = mask, 0, m
    least, at = m, 0
    for j, c in enumerate(text):
        eq = places.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(x | up) & mask, up & x
        if more & top:
            now += 1
        elif less & top:
            now -= 1
        more, less = more << 1 & mask, less << 1 & mask
        up, down = less | ~((x & ~down | eq | down) | more) & mask, more & (eq | x)
        if now < least:
            least, at = now, j + 1
    return least, at


class Items:
    """A block of items with their q-grams, walks and tables; made once per worker."""

    def __init__(self, ids: list[int], texts: list[str], share: float, q: int):
        self.ids, self.texts, self.q = np.array(ids, dtype=np.int64), texts, q
        points = [code_points(t) for t in texts]
        self.length = np.array([len(p) for p in points], dtype=np.int64)
        self.edits = np.array([edits_allowed(n, share) for n in self.length], dtype=np.int64)
        self.need = np.maximum(1, self.length - q + 1 - self.edits * q)
        hashes = [gram_hashes(p, q) for p in points]
        grams = np.concatenate(hashes)
        order = np.argsort(grams, kind="stable")
        self.item = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])[order]
        self.offset = np.concatenate([np.arange(len(h)) for h in hashes])[order]
        self.grams, self.first, self.many = np.unique(grams[order], return_index=True, return_counts=True)
        self.present = np.zeros(1 << 22, dtype=bool)
        self.present[self.grams >> np.uint64(42)] = True
        source = np.random.default_rng(20_240_131)
        longest = int(2 * self.length.max())
        self.coins = source.integers(0, 2, (WALKS, longest, 256), dtype=np.int8)
        self.spots = source.random((WALKS, -(-TABLES // WALKS), SAMPLED))
        self.walked = self._tables(np.arange(len(texts)), *_laid(points))

    def _tables(self, item: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(walks, strings, tables, places): characters at the sampled places of the walks over given strings."""
        steps = 2 * self.length[item]
        rows, out = np.arange(len(item)), []
        for coins, spots in zip(self.coins, self.spots):
            at, seen = starts.copy(), np.zeros((len(item), int(steps.max())), dtype=np.uint32)
            for j in range(seen.shape[1]):
                inside = at < ends
                c = np.where(inside, text[np.minimum(at, len(text) - 1)], 0)
                seen[:, j] = c
                at += coins[j][c & 255] & inside
            place = (spots.reshape(1, -1) * steps[:, None]).astype(np.int64)
            out.append(seen[rows[:, None], place].reshape(len(item), *spots.shape))
        return np.stack(out)

    def collide(self, item: np.ndarray, windows: list[np.ndarray]) -> np.ndarray:
        """Which item-sized windows agree with their item in all places of some table."""
        hit = np.zeros(len(item), dtype=bool)
        for a in range(0, len(item), 2048):
            some = slice(a, a + 2048)
            walked = self._tables(item[some], *_laid(windows[some]))
            hit[some] = (walked == self.walked[:, item[some]]).all(axis=3).any(axis=(0, 2))
        return hit

    def clusters(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, start) of the windows that have q-grams enough near them, by item and start."""
        none = np.zeros(0, dtype=np.int64)
        hashes = gram_hashes(points, self.q)
        where = np.flatnonzero(self.present[hashes >> np.uint64(42)])
        if not len(where):
            return none, none
        place = np.minimum(np.searchsorted(self.grams, hashes[where]), len(self.grams) - 1)
        same = self.grams[place] == hashes[where]
        where, place = where[same], place[same]
        many = self.many[place]
        if not len(where):
            return none, none
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        occurrence = np.repeat(self.first[place], many) + step
        item, start = self.item[occurrence], np.repeat(where, many) - self.offset[occurrence]
        span = len(points) + 2 * int(self.length.max()) + 1
        code = np.sort(item * span + start + int(self.length.max()))
        item = code // span
        ahead = np.searchsorted(code, code + self.edits[item], side="right") - np.arange(len(code))
        full = np.flatnonzero(ahead >= self.need[item])
        if not len(full):
            return none, none
        # Every start in a full stretch, once.
        edge = np.zeros(len(code) + 1, dtype=np.int64)
        np.add.at(edge, full, 1)
        np.add.at(edge, full + ahead[full], -1)
        code = np.unique(code[np.cumsum(edge[:-1]) > 0])
        return code // span, code % span - int(self.length.max())

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Per text (item_id, start, end, edits) of its passages, the best of each cluster of windows.

        The windows of all the texts walk together.
        """
        laid, items, windows = [], [], []
        for place, text in enumerate(texts):
            points = code_points(text.replace("İ", "i").lower()).copy()
            points[(points >= 9) & (points <= 13)] = 32
            item, start = self.clusters(points)
            if len(item):
                laid.append((place, item, start))
                items.append(item)
                ends = start + self.length[item]
                windows += [points[max(0, a):b].copy() for a, b in zip(start.tolist(), ends.tolist())]
        found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not laid:
            return found
        met, at = self.collide(np.concatenate(items), windows), 0
        for place, item, start in laid:
            found[place] = self._verify(normal(texts[place]), item, start, met[at:at + len(item)])
            at += len(item)
        return found

    def _verify(self, text: str, item: np.ndarray, start: np.ndarray, met: np.ndarray) -> list[tuple[int, int, int, int]]:
        first = np.concatenate([[True], (item[1:] != item[:-1]) | (start[1:] - start[:-1] > self.edits[item[1:]])])
        begins, out = np.flatnonzero(first), []
        ends = np.append(begins[1:], len(item))
        for begin, end in zip(begins, ends):
            if not met[begin:end].any():
                continue
            of, low, high = int(item[begin]), int(start[begin]), int(start[end - 1])
            length, allowed, pattern = int(self.length[of]), int(self.edits[of]), self.texts[of]
            a, b = max(0, low - allowed), high + length + allowed
            region = text[a:b]
            exact = region.find(pattern)
            if exact >= 0:
                out.append((int(self.ids[of]), a + exact, a + exact + length, 0))
                continue
            edits, stop = best_end(pattern, region)
            if edits <= allowed:
                _, back = best_end(pattern[::-1], region[:stop][::-1])
                out.append((int(self.ids[of]), a + stop - back, a + stop, edits))
        return out


def _laid(points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in points], dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.concatenate(points), ends - lengths, ends


def item_blocks(items: DataFrame, min_chars: int = MIN_CHARS, id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """Blocks of (id, normal text) of at most BLOCK_CHARS characters, fetched partition by partition.

    Items of a null id, and items of under `min_chars` characters, empty and null ones
    included, are left out: so short a text is found everywhere by chance. Of repeated
    rows one counts.
    """
    rows = items.select(F.col(id).cast("bigint").alias("i"), F.col(text).cast("string").alias("t")).where(
        (F.length("t") >= min_chars) & F.col("i").isNotNull()).distinct().orderBy("i", "t")
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and size + len(row["t"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["i"], normal(row["t"])))
        size += len(row["t"])
    if block:
        yield block


def _finder(spark, block: list[tuple[int, str]], share: float, q: int):
    shared = spark.sparkContext.broadcast(block)

    def make() -> Items:
        return Items([i for i, _ in shared.value], [t for _, t in shared.value], share, q)

    return make


def find_passages(
    docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE, q: int = Q, min_chars: int = MIN_CHARS,
    id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, item_id, start, end, edits): passages of items in whole texts, at most share x item length edits each.

    Case and kinds of white space do not count as edits; positions are code points,
    end exclusive. A null text holds nothing; repeated rows report each for
    themselves. Without items or documents the result is empty.
    """
    spark, rows = docs.sparkSession, id_and_text(docs, id, text)
    schema = pa.schema([(name, pa.int64() if name.endswith("id") else pa.int32()) for name in FIELDS])

    def search(make):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = make()
            for batch in batches:
                table = batch.to_pydict()
                found = block.find(["" if t is None else t for t in table["_text"]])
                hits = [(i, *hit) for i, own in zip(table["_id"], found) for hit in own]
                yield pa.RecordBatch.from_pydict(
                    {name: [h[k] for h in hits] for k, name in enumerate(FIELDS)}, schema=schema)

        return rows.mapInArrow(tidy(run), HITS)

    parts = [search(_finder(spark, b, share, q)) for b in item_blocks(items, min_chars, item_id, item_text)]
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], HITS)
    return found.withColumnRenamed("_id", id)


def drop_contaminated(
    docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE, q: int = Q, min_chars: int = MIN_CHARS,
    text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of `docs` that hold no passage of an item, with their own columns only.

    Rows of null and empty texts hold none and stay; repeated rows stay or go together; ids are
    not read. Without items all rows stay; an empty table stays empty.
    """
    kept = docs
    for block in item_blocks(items, min_chars, item_id, item_text):
        kept = kept.where(_is_clean(_finder(docs.sparkSession, block, share, q))(F.col(text)))
    return kept


def _is_clean(make):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        block = make()
        for batch in batches:
            yield pd.Series([not own for own in block.find(["" if t is None else t for t in batch])], dtype=bool)
        release()

    return clean
