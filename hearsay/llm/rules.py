"""A ledger of quality rules: what each rule measured and which failed, so that policies are masks over bits.

Every rule is evaluated once per document. A ledger row holds the measurements and
one integer whose bit r is set where rule r fails. A policy is a versioned set of rules: a
document is kept if none of its bits is in the policy's mask. Changing a policy, comparing
two, or asking what each rule takes away alone reads the ledger, never the texts.

Words are `[^\\x20\\x09-\\x0D]+`. A null text is an empty one: it fails the word count and no
other rule. Null ids stay null; repeated rows have a row each; other columns are not
read. An empty table gives an empty ledger. Whole texts are measured, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import fresh_path
from .common import id_and_text

# Words of a window of the repetition rule.
WINDOW = 5

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper", "n_exclaims", "n_letter_words",
)

# Bit by bit: name and condition of failure over the measurements. Bits are never given to another rule.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 3 * n_words or word_chars > 10 * n_words)"),
    ("no_letters", "100 * n_letter_words < 60 * n_words"),
    ("shouting", "n_letters >= 50 and 2 * n_upper > n_letters"),
    ("exclamations", "n_words >= 10 and 2 * n_exclaims > n_words"),
)
BIT = {name: 1 << bit for bit, (name, _) in enumerate(RULES)}

# Versions of the policy: the rules that reject. Old versions stay as they were.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "no_letters", "shouting", "exclamations"),
}
BASE, CURRENT = 1, 2

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[ord("a"):ord("z") + 1] = True
# A letter of a word: an ASCII letter or any character beyond ASCII.
_LETTER = _UPPER | _LOWER
_LETTER[0x80:] = True
_FIRST = np.ones(256, dtype=bool)  # first byte of a code point
_FIRST[0x80:0xC0] = False


def mask_of(names) -> int:
    return sum(BIT[n] for n in names)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set in each part; bounds has one entry more than there are parts."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _codes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number per piece of `data`, equal for equal bytes."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return pieces.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _repeats(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of WINDOW words found at least twice in it. `first`: where each text begins."""
    n = len(words)
    counts = np.diff(first)
    marks = np.zeros(n + 1, dtype=np.int64)
    if n < WINDOW:
        return np.zeros(len(counts), dtype=np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    # Numbers of ever longer runs; runs across two texts are told apart by the text they start in and left out below.
    run = pd.factorize(text * (words.max() + 1) + words)[0]
    for k in range(1, WINDOW):
        run = pd.factorize(run[:-1] * (words.max() + 1) + words[k:])[0]
    within = text[:n - WINDOW + 1] == text[WINDOW - 1:]
    often = np.bincount(run[within], minlength=run.max() + 1) > 1
    at = np.flatnonzero(within & often[run])
    np.add.at(marks, at, 1)
    np.add.at(marks, at + WINDOW, -1)
    return _sums(np.cumsum(marks[:-1]) > 0, first)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset:raw.offset + len(raw) + 1]
    buffer = raw.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8)[bounds[0]:bounds[-1]] if buffer is not None else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]

    inside = ~_SPACE[data]
    text_start = np.zeros(len(data) + 1, dtype=bool)
    text_start[bounds[:-1]] = True
    starts = inside & (np.concatenate([[True], ~inside[:-1]])[:len(data)] | text_start[:-1])
    word_at = np.flatnonzero(starts)
    words_first = np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])[bounds]
    in_words = data[inside]
    place = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    edges = np.append(place[word_at], len(in_words))
    codes = _codes(in_words, np.diff(edges))

    # Lines: parted by new lines, each with the bytes between them.
    breaks = data == 0x0A
    cut = np.unique(np.concatenate([np.flatnonzero(breaks), bounds])).astype(np.int64)
    line_from, line_to = cut[:-1], cut[1:]
    line_from = line_from + breaks[line_from]
    full = place[line_to] > place[line_from]
    line_from, line_to = line_from[full], line_to[full]
    text_of = np.searchsorted(bounds, line_from, side="right") - 1
    lengths = line_to - line_from
    edge = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(edge, line_from, 1)
    np.add.at(edge, line_to, -1)
    lines = _codes(data[np.cumsum(edge[:-1]) > 0], lengths)
    n_lines = np.bincount(text_of, minlength=len(raw))
    distinct = np.unique(text_of * (lines.max() + 1 if len(lines) else 1) + lines)
    n_distinct = np.bincount(distinct // (lines.max() + 1), minlength=len(raw)) if len(lines) else n_lines

    upper = _UPPER[data]
    with_letter = np.concatenate([[0], np.cumsum(_LETTER[in_words], dtype=np.int64)])
    letter_words = np.concatenate([[0], np.cumsum(with_letter[edges[1:]] > with_letter[edges[:-1]], dtype=np.int64)])
    return {
        "n_words": np.diff(words_first),
        "word_chars": _sums(inside & _FIRST[data], bounds),
        "n_symbols": _sums(_SYMBOL[data], bounds),
        "n_dup_lines": n_lines - n_distinct,
        "n_repeat_words": _repeats(codes, words_first),
        "n_lines": n_lines,
        "n_letters": _sums(upper | _LOWER[data], bounds),
        "n_upper": _sums(upper, bounds),
        "n_exclaims": _sums(data == ord("!"), bounds),
        "n_letter_words": letter_words[words_first[1:]] - letter_words[words_first[:-1]],
    }


def _failures() -> Column:
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, (_, rule) in enumerate(RULES)]
    fails = bits[0]
    for bit in bits[1:]:
        fails = fails.bitwiseOR(bit)
    return fails


def evaluate(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, measurements, fails): every rule on every row of `docs`, once."""
    schema = pa.schema([("_id", pa.int64()), *[(m, pa.int64()) for m in MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), *[pa.array(found[m].astype(np.int64)) for m in MEASURES]], schema=schema)

    measured = id_and_text(docs, id, text).mapInArrow(run, ", ".join(["_id bigint", *[f"{m} bigint" for m in MEASURES]]))
    return measured.select(F.col("_id").alias(id), *MEASURES, _failures().alias("fails"))


def write_ledger(docs: DataFrame, path: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger as written to `path`, or to a new folder in the shared one, and read again."""
    spark = docs.sparkSession
    rows = evaluate(docs, id, text)
    path = path or fresh_path(spark, "ledger")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def rejects(version: int) -> Column:
    return F.col("fails").bitwiseAND(F.lit(mask_of(POLICIES[version]))) != 0


def keep(docs: DataFrame, ledger: DataFrame, version: int = CURRENT, id: str = "doc_id") -> DataFrame:
    """Rows of `docs` that the policy keeps, by their id; rows of a null id, whose verdict nothing names, stay."""
    bad = ledger.where(rejects(version) & F.col(id).isNotNull()).select(id).distinct()
    return docs.join(bad, id, "left_anti")


def masks(ledger: DataFrame) -> DataFrame:
    """(fails, n): how many rows have which bits; at most 2 ** len(RULES) rows however many documents there are."""
    return ledger.groupBy("fails").agg(F.count(F.lit(1)).alias("n"))


def ablations(ledger: DataFrame, version: int = CURRENT) -> DataFrame:
    """(rule, failing, alone, kept, kept_without) of each rule of a policy, from the counts of masks.

    `failing` rows break the rule, `alone` break no other rule of the policy,
    `kept` is what the policy keeps and `kept_without` what it would keep without the rule.
    An empty ledger has no rows.
    """
    policy = mask_of(POLICIES[version])
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit")) for name in POLICIES[version]])
    pairs = masks(ledger).select("n", "fails", F.col("fails").bitwiseAND(F.lit(policy)).alias("inside"), F.inline(rules))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    none, only = F.col("inside") == 0, F.col("inside") == F.col("bit")
    return pairs.groupBy("rule").agg(
        total(F.col("fails").bitwiseAND(F.col("bit")) != 0).alias("failing"), total(only).alias("alone"),
        total(none).alias("kept"), total(none | only).alias("kept_without"))


def summary(ledger: DataFrame, *by: str) -> DataFrame:
    """Per group: rows, the rules that failed anywhere, those that failed everywhere, and the bits set in all."""
    return ledger.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("fails").alias("any_fails"), F.bit_and("fails").alias("all_fails"),
        F.sum(F.bit_count("fails")).alias("n_fails"))
