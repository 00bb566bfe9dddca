"""Column expressions on text: tokens, shingles, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD = r"[\p{L}\p{M}\p{N}]+"
HAN = r"\p{IsHan}"
HAN_OR_WORD = rf"{HAN}+|[\p{{L}}\p{{M}}\p{{N}}&&[^{HAN}]]+"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _bigrams(run: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.when(run.rlike(rf"^{HAN}{{2,}}$"), pairs).otherwise(F.array(run))


def tokens(text) -> Column:
    """Lower-case words; runs of Han characters become character pairs."""
    lowered = F.lower(_col(text))
    words = F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))
    runs = F.regexp_extract_all(lowered, F.lit(HAN_OR_WORD), F.lit(0))
    return F.when(lowered.rlike(HAN), F.flatten(F.transform(runs, _bigrams))).otherwise(words)


def _with(value: Column, use) -> Column:
    """Evaluate `value` once and pass it to `use`, which may read it in a lambda."""
    return F.transform(F.array(value), use)[0]


def shingles(words: Column, n: int = 3) -> Column:
    """Distinct hashes of all runs of n words; empty below n words."""
    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - F.lit(n - 1))
        hashed = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))
        return F.when(F.size(w) >= n, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))

    return _with(words, runs)


def jaccard(a, b) -> Column:
    a, b = _col(a), _col(b)
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common, F.size(a) + F.size(b) - common), F.lit(0.0))


def fingerprint(text) -> Column:
    """Equal for texts that differ only in case and white space."""
    return F.md5(F.lower(F.trim(F.regexp_replace(_col(text), r"[ \t\r\n\f]+", " "))))
