"""Token ids as fixed-width bit packs, with offsets for random access.

A packed folder is a Parquet table of blocks, so it is written atomically task by
task, read from any store, and lost executors only repeat their tasks:

    chunk, block   place of the block: chunks in id order, blocks within a chunk
    width          bits of an id, the least that hold the vocabulary
    n_ids          ids in the block
    ids            n_ids values of `width` bits, most significant bit first, zero-padded to a byte
    doc_ids        ids of the documents in the block, in order (null: no id)
    offsets        where each document begins, in ids from the start of the block

A document is never split between blocks. Any run of ids is a slice of bits, so a
document is unpacked without touching its neighbours. Where a chunk begins
in the whole sequence follows from the totals of the chunks before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import fresh_path
from .common import id_and_text, ordered_chunks, partitions, tidy

END_ID = 1
BLOCK_IDS = 1 << 18
# Pieces of words whose ids a task keeps, and as many older ones.
PIECE_STORE = 100_000
# Bytes of the texts whose words are looked up together; the arrays over them take some 20 times as much.
SLICE_BYTES = 1 << 19

# Letters of ASCII and Latin-1, and words of them.
LOWER = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
UPPER = "".join(map(chr, [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
LATIN = f"^[{UPPER}{LOWER}]+$"
# Words that may go to the model without the file's normaliser and pre-tokenizer, narrowest last.
PLAIN = {"latin": LOWER, "ascii": LOWER[:26]}

BLOCKS = "chunk int, block int, width int, n_ids bigint, ids binary, doc_ids array<bigint>, offsets array<bigint>"


def width_of(vocabulary: int) -> int:
    """Bits that hold the ids 0 .. vocabulary - 1; at least one."""
    return max(1, (int(vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as consecutive groups of `width` bits (1 to 32)."""
    ids = np.asarray(ids, dtype=np.uint32)
    if width == 16:
        return ids.astype(">u2").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width:].ravel()).tobytes()


def unpack(packed: bytes, width: int, first: int, n: int) -> np.ndarray:
    """The n ids from place `first` on, read from their own bytes only."""
    if n == 0:
        return np.zeros(0, dtype=np.uint32)
    begin, end = first * width, (first + n) * width
    raw = np.frombuffer(packed, dtype=np.uint8)[begin // 8:-(-end // 8)]
    if width == 16:
        return raw.view(">u2").astype(np.uint32)
    bits = np.unpackbits(raw)[begin % 8:begin % 8 + n * width].reshape(n, width)
    full = np.zeros((n, 32), dtype=np.uint8)
    full[:, 32 - width:] = bits
    return np.packbits(full, axis=1).view(">u4").ravel().astype(np.uint32)


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The runs flat[first[i]:first[i] + size[i]] for every i of index, one after another."""
    lengths = size[index]
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    places = np.repeat(first[index] - (ends - lengths), lengths)
    places += np.arange(ends[-1])
    return flat[places]


def _looked_up(slots: dict[bytes, int], pieces: np.ndarray) -> np.ndarray:
    """Slot of each piece, -1 for one that is not there."""
    return np.fromiter(map(slots.get, pieces.tolist(), repeat(-1)), dtype=np.int64, count=len(pieces))


class Known:
    """Ids of pieces: `slot` names a piece's place in `first` and `size`, its run of `flat`."""

    def __init__(self):
        self.slot: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 12, dtype=np.uint32), 0
        self.first, self.size = np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 10, dtype=np.int64)

    def add(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of new pieces, one run after another."""
        n, self.used = len(self.slot), self.used + len(ids)
        while self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(pieces) > len(self.first):
            self.first, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.size))
        start = self.used - len(ids)
        self.flat[start:self.used] = ids
        self.size[n:n + len(pieces)] = sizes
        self.first[n:n + len(pieces)] = start + np.cumsum(sizes) - sizes
        self.slot.update(zip(pieces, range(n, n + len(pieces))))


class WordEncoder:
    """Texts -> ids of the whole texts, encoding each distinct word once.

    For a tokenizer that drops white space: its pieces never span it, so the ids of
    a text are those of its words one after another. What else its own normaliser
    and pre-tokenizer do is asked of them: where they part letters from marks, a word
    and the marks behind it are looked up apart; where they fold case, ASCII words
    are looked up in lower case. Words are found, folded and put together again for
    many texts at once; only distinct pieces are looked up one by one. Many new ones go
    to the library in one call, parted by a control character of one id, or, if all are
    letters and the model marks the ends of words, by those ends. Where the normaliser and the
    pre-tokenizer leave lower-case Latin words as they are, these go to the same model without them.
    """

    MARK = "\x01"
    TAIL = ".,!?;:"

    def __init__(self, content: str):
        self.tokenizer, self.ends, self.latin, self.plain = _loaded(content)
        mark = self._ids(self.MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.recent, self.older = Known(), Known()
        cutter, normalizer = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        self.parts = cutter is not None and [p for p, _ in cutter.pre_tokenize_str("ab.!,;:?cd")] == ["ab", ".!,;:?", "cd"]
        self.folds = normalizer is not None and normalizer.normalize_str("AbZ") == "abz"
        self.compared: set[str] = set()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _batch(self, text: str, kind: str = "") -> np.ndarray:
        tokenizer = self.plain.get(kind, self.tokenizer)
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _by_ends(self, pieces: list[bytes], kind: str) -> list[bytes]:
        """Learn pieces of letters, one word each to the library; gives back those of a call in which it sees otherwise."""
        left = []
        for a in range(0, len(pieces), 1024):
            group = pieces[a:a + 1024]
            text = b" ".join(group).decode()
            ids = self._batch(text, kind)
            if kind in self.plain and kind not in self.compared:
                # The first call of an encoder is made both ways.
                self.compared.add(kind)
                if not np.array_equal(ids, self._batch(text)):
                    raise ValueError("the tokenizer changes words of lower-case letters")
            ends = np.flatnonzero(self.ends[ids]) + 1
            # A piece of letters gives one end at least, so as many ends as pieces are one each.
            if len(ends) == len(group) and ends[-1] == len(ids):
                self.recent.add(group, ids, np.diff(ends, prepend=0))
            else:
                left += group
        return left

    def _by_marks(self, pieces: list[bytes]) -> None:
        mark = self.MARK.encode()
        alone = [w for w in pieces if self.mark is None or mark in w]
        for w in alone:
            ids = np.array(self._ids(w.decode("utf-8", "replace")), dtype=np.uint32)
            self.recent.add([w], ids, np.array([len(ids)]))
        plain = pieces if not alone else [w for w in pieces if w not in set(alone)]
        for a in range(0, len(plain), 1024):
            group = plain[a:a + 1024]
            ids = self._batch((b" " + mark + b" ").join(group).decode("utf-8", "replace"))
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != len(group) - 1:
                raise ValueError("the tokenizer joins words across white space")
            sizes = np.diff(np.append(marks, len(ids)), prepend=-1) - 1
            self.recent.add(group, ids[ids != self.mark], sizes)

    def _slots(self, distinct: pa.Array) -> np.ndarray:
        """Places of distinct pieces in the recent store, which learns those it lacks from the older one or the library."""
        if len(self.recent.slot) > PIECE_STORE:
            self.older, self.recent = self.recent, Known()
        # Far faster than to_pylist, which makes a scalar of each.
        pieces = distinct.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        known = _looked_up(self.recent.slot, pieces)
        lacking = np.flatnonzero(known < 0)
        if len(lacking):
            lacked = pieces[lacking]
            held = _looked_up(self.older.slot, lacked)
            old, new = held >= 0, held < 0
            if old.any():
                ids = gather(self.older.flat, self.older.first, self.older.size, held[old])
                self.recent.add(lacked[old].tolist(), ids, self.older.size[held[old]])
            self._learn(lacked[new], distinct.take(pa.array(lacking[new])))
            known[lacking] = _looked_up(self.recent.slot, lacked)
        return known

    def _learn(self, pieces: np.ndarray, words: pa.Array) -> None:
        """Ask the library for new pieces, which `words` are too, each in the cheapest way it allows."""
        kinds = np.zeros(len(pieces), dtype=np.int8)
        names = ["letters", *self.plain]
        if self.ends is not None:
            kinds[pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)] = 1
        for of, kind in enumerate(self.plain, start=2):
            kinds[pc.match_substring_regex(words, f"^[{PLAIN[kind]}]+$").to_numpy(zero_copy_only=False)] = of
        left = pieces[kinds == 0].tolist()
        for of, kind in enumerate(names, start=1):
            left += self._by_ends(pieces[kinds == of].tolist(), kind)
        self._by_marks(left)

    def _pieces(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(pieces, which words have a tail, the tails): distinct words as what is looked up of them, tails last."""
        stems, tailed = words, np.zeros(len(words), dtype=bool)
        tails = words.slice(0, 0)
        if self.parts:
            bare = pc.utf8_rtrim(words, characters=self.TAIL)
            longer = np.asarray(pc.binary_length(words)) - np.asarray(pc.binary_length(bare))
            letters = pc.match_substring_regex(bare, LATIN) if self.latin else pc.ascii_is_alpha(bare)
            tailed = (longer > 0) & letters.to_numpy(zero_copy_only=False)
            stems = pc.if_else(pa.array(tailed), bare, words)
            of = np.where(tailed, longer, 0)
            parts = [words.filter(pa.array(of == k)).cast(pa.large_binary()) for k in np.unique(of[tailed])]
            cut = [pc.binary_slice(p, -int(k)).cast(pa.large_string()) for p, k in zip(parts, np.unique(of[tailed]))]
            order = np.concatenate([np.flatnonzero(of == k) for k in np.unique(of[tailed])]) if cut else np.zeros(0, dtype=np.int64)
            if cut:
                tails = pa.concat_arrays(cut).take(pa.array(np.argsort(order, kind="stable")))
        if self.folds:
            stems = pc.if_else(pc.string_is_ascii(stems), pc.ascii_lower(stems), stems)
            if self.latin:
                stems = pc.if_else(pc.match_substring_regex(stems, LATIN), pc.utf8_lower(stems), stems)
        return pa.concat_arrays([stems, tails]), tailed, np.flatnonzero(tailed)

    def _flat(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of the texts in them) of texts that lie in `data` between `bounds`."""
        inside = _SOLID.take(data)
        edge = inside.copy()  # first bytes of words
        edge[1:] &= ~inside[:-1]
        begins = bounds[:-1][bounds[:-1] < len(data)]
        edge[begins] = inside[begins]
        starts = np.flatnonzero(edge)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(bounds), dtype=np.int64)
        words_to = np.searchsorted(starts, bounds)
        # Without white space a word begins where so many solid bytes lie before it.
        blank = np.flatnonzero(~inside)
        offsets = np.append(starts - np.searchsorted(blank, starts), len(data) - len(blank))
        solid = data[inside]
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(solid))
        coded = words.dictionary_encode()
        index, distinct = coded.indices.to_numpy(), coded.dictionary
        pieces, tailed, at = self._pieces(distinct)
        coded = pieces.dictionary_encode()
        slots = self._slots(coded.dictionary)[coded.indices.to_numpy()]
        # A word is its stem, then its tail if it has one.
        n, known = len(distinct), self.recent
        shift = np.concatenate([[0], np.cumsum(tailed)[:-1]])
        run = np.empty(len(slots), dtype=np.int64)
        run[np.arange(n) + shift] = slots[:n]
        run[at + shift[at] + 1] = slots[n:]
        size = known.size[slots[:n]].copy()
        size[at] += known.size[slots[n:]]
        flat = gather(known.flat, known.first, known.size, run)
        ids = gather(flat, np.cumsum(size) - size, size, index)
        return ids, np.concatenate([[0], np.cumsum(size[index])])[words_to]

    def encode(self, texts: pa.Array | list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, a null one being empty; some texts at a time, however long the batch."""
        array = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        raw = array.cast(pa.large_string()).fill_null("")
        bounds = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset:raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], dtype=np.uint8) if raw.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < len(raw):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")) - 1)
            ids, cuts = self._flat(data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield ids[a:b]
            at = to


# Bytes that are not white space.
_SOLID = np.ones(256, dtype=bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False


@lru_cache(maxsize=1)
def _loaded(content: str) -> tuple:
    """(tokenizer, which ids end a word, whether Latin letters are treated as ASCII ones, tokenizers of plain words by kind) of a file.

    The last two are False and empty unless the file's own steps, asked for all pairs of letters, do to them what is
    supposed here. A worker keeps them for its other tasks: to load the file takes it as long as 0.5 MB of texts.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_str(content)
    cutter, normalizer = tokenizer.pre_tokenizer, tokenizer.normalizer
    ends, suffix = None, getattr(tokenizer.model, "end_of_word_suffix", None)
    if suffix:
        vocabulary = tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        ends[[v for k, v in vocabulary.items() if k.endswith(suffix)]] = True
    if cutter is None or normalizer is None:
        return tokenizer, ends, False, {}

    def pieces(by, text: str) -> list[str]:
        return [p for p, _ in by.pre_tokenize_str(text)]

    def words(letters: str) -> str:
        return " ".join([*(a + b for a in letters for b in letters), letters * 4, *letters])

    tail, small, capitals = WordEncoder.TAIL, words(LOWER), words(UPPER)
    latin = normalizer.normalize_str(small) == small and normalizer.normalize_str(capitals) == capitals.lower() and all(
        pieces(cutter, a + tail + a) == [*pieces(cutter, a), *pieces(cutter, tail), *pieces(cutter, a)] for a in LOWER)
    split = pre_tokenizers.WhitespaceSplit()
    to_bytes = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    plain: dict[str, Tokenizer] = {}
    for kind, letters in PLAIN.items() if ends is not None else ():
        text = words(letters)
        same = [by for by in (split, to_bytes) if normalizer.normalize_str(text) == text and pieces(by, text) == pieces(cutter, text)]
        if same:
            plain[kind] = Tokenizer(tokenizer.model)
            plain[kind].pre_tokenizer = same[0]
    return tokenizer, ends, latin, plain


def tokenizer_file(path: str | None = None) -> str:
    """Content of the tokenizer's file; the public word tokenizer unless a path is given."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def vocabulary_of(content: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_str(content).get_vocab_size(with_added_tokens=True)


def write_packed(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
    id: str = "doc_id", text: str = "text",
) -> str:
    """Encode whole texts and write them as blocks in ascending id order; gives the path back.

    `tokenizer` is the path of a file of the tokenizers library whose pre-tokenizer
    drops white space. Every row is one document closed by `end_id`, a null or empty
    text just the end id. Rows of a null id come first, rows of one id in the order
    of their texts, so equal inputs give equal files. An empty table gives no block.
    """
    spark = docs.sparkSession
    content = tokenizer_file(tokenizer)
    width = width_of(max(vocabulary_of(content), end_id + 1))
    shared = spark.sparkContext.broadcast(content)
    rows, _ = ordered_chunks(id_and_text(docs, id, text))
    dealt = rows.repartition(partitions(spark), "_chunk").sortWithinPartitions(
        "_chunk", "_key", F.col("_text").asc_nulls_first()
    ).select("_chunk", "_id", "_text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(shared.value)  # its store goes with the task
        end = np.array([end_id], dtype="<u4")
        open_, chunk, block, n = [], None, 0, 0

        def close():
            lengths = np.array([len(ids) for _, ids in open_])
            offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            packed = pack(np.concatenate([ids for _, ids in open_]), width)
            names = [pa.array([v], t) for v, t in (
                (chunk, pa.int32()), (block, pa.int32()), (width, pa.int32()), (int(lengths.sum()), pa.int64()),
                (packed, pa.binary()), ([d for d, _ in open_], pa.list_(pa.int64())), (offsets.tolist(), pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays(names, names=["chunk", "block", "width", "n_ids", "ids", "doc_ids", "offsets"])

        for batch in batches:
            coded = encoder.encode(batch.column("_text"))
            for of, doc, ids in zip(batch.column("_chunk").to_pylist(), batch.column("_id").to_pylist(), coded):
                ids = np.concatenate([ids, end])
                if open_ and (of != chunk or n + len(ids) > BLOCK_IDS):
                    yield close()
                    block, open_, n = (0 if of != chunk else block + 1), [], 0
                elif of != chunk:
                    block = 0
                chunk, n = of, n + len(ids)
                open_.append((doc, ids))
        if open_:
            yield close()

    dealt.mapInArrow(tidy(run), BLOCKS).write.parquet(path)
    return path


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with `first`, the number of ids before the block in the whole sequence."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("chunk", "block").agg(F.sum("n_ids").alias("_n"))
    # Blocks are counted within their chunk; only the chunks, a few for each partition, are counted one after another.
    inside = Window.partitionBy("chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    chunks = totals.groupBy("chunk").agg(F.sum("_n").alias("_n"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    places = totals.withColumn("_within", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(chunks), "chunk")
    # A row of three numbers per block goes to the blocks, so their ids are neither shuffled nor sorted.
    firsts = places.select("chunk", "block", (F.col("_before") + F.col("_within")).alias("first"))
    return blocks.join(F.broadcast(firsts), ["chunk", "block"])


def read_documents(blocks: DataFrame, id: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per document, from its own slice of the packed ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_pylist():
                cuts = [*row["offsets"], row["n_ids"]]
                lengths = np.diff(cuts)
                ids = unpack(row["ids"], row["width"], 0, row["n_ids"]).astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array((np.array(cuts[:-1], dtype=np.int64) + row["first"])),
                     pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())],
                    names=["_id", "start", "n_tokens", "ids_crc32"])

    found = blocks.select("width", "n_ids", "ids", "doc_ids", "offsets", "first").mapInArrow(
        tidy(run), "_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.select(F.col("_id").alias(id), "start", "n_tokens", "ids_crc32")


def packed_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write `docs` as a packed folder in the shared folder and give its documents as read back."""
    spark = docs.sparkSession
    path = write_packed(docs, fresh_path(spark, "packed"), tokenizer, end_id, id, text)
    return read_documents(read_blocks(spark, path), id)
