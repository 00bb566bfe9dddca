"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

It looks at windows of a few words, so a toxic passage counts the same in a long text
as in a short one; what the highest windows of a text sum up to is calibrated into its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import class_weights, code_points, fit_logistic, fold, label_sample, release, sigmoid

ORDERS = (3, 4, 5, 6)
BITS = 18
# Characters of a window and between the starts of two: a few words, for a passage is toxic and seldom a whole text.
WINDOW, STEP = 24, 12
PER_CLASS = 1_000
MOST_CHARS = 4_000_000
PARTS = 4
TURNS, ROUNDS = 4, 50
RATE = 0.05
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7

_STEP = np.uint64(1099511628211)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def slots_of(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """(orders, characters) slots of the character n-grams that start at each character; 2 ** bits where none does."""
    points = code_points(f" {text.lower()} ").astype(np.uint64)
    out = np.full((len(orders), len(points)), 1 << bits, dtype=np.int32)
    h, shift = points * _MIX, np.uint64(64 - bits)
    for n in range(2, max(orders) + 1):
        if len(points) < n:
            break
        h = h[:-1] * _STEP + points[n - 1:] * _MIX
        if n in orders:
            out[orders.index(n), :len(h)] = (((h ^ np.uint64(n)) * _MIX) >> shift).astype(np.int32)
    return out


def starts_of(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - WINDOW + STEP), STEP)


def window_sums(slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The summed weights of each window's n-grams. `weights` has a last entry 0 for no n-gram."""
    total = np.concatenate([[0.0], np.cumsum(weights[slots].sum(axis=0))])
    first = starts_of(slots.shape[1])
    return total[np.minimum(first + WINDOW, slots.shape[1])] - total[first]


def measures(sums: np.ndarray) -> tuple[float, ...]:
    """What a text's windows say: the highest, the second, third and fifth highest that do not overlap, their mean and number."""
    apart = np.sort(sums[::max(1, WINDOW // STEP)])[::-1]
    at = [apart[min(k, len(apart) - 1)] for k in (1, 2, 4)]
    return (sums.max(), *at, sums.mean(), np.log(len(sums)))


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the slots, log-count ratios included, as 32-bit floats, and the calibration of the windows' sums."""

    weights: bytes
    calibration: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    base: float

    def scorer(self):
        if not self.weights:
            return lambda texts: np.full(len(texts), self.base)
        weights = np.frombuffer(self.weights, np.float32).astype(np.float64)
        calibration, mean, scale = np.array(self.calibration), np.array(self.mean), np.array(self.scale)

        def score(texts: list[str]) -> np.ndarray:
            if not texts:
                return np.zeros(0)
            raw = np.clip([measures(window_sums(slots_of(t), weights)) for t in texts], self.low, self.high)
            return sigmoid(np.column_stack([(raw - mean) / scale, np.ones(len(raw))]) @ calibration)

        return score


def _fit(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weights of the slots: log-count ratios times what a linear classifier finds on one window of each text.

    The window of a text is the one its present weights find most toxic: it is chosen
    anew TURNS times, at first by the ratios alone. A window is the set of its n-grams,
    each counting with its ratio; both classes weigh the same.
    """
    slots = 1 << BITS
    counts = np.ones((2, slots + 1))
    for s, k in zip(texts, y):
        counts[int(k), np.unique(s)] += 1
    totals = np.array([(y == 0).sum(), (y == 1).sum()]) + 1
    ratios = np.log(counts[1] / totals[1]) - np.log(counts[0] / totals[0])
    ratios[slots] = 0.0
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w = np.ones(slots + 1)
    for _ in range(TURNS):
        found = []
        for s in texts:
            at = STEP * int(np.argmax(window_sums(s, w * ratios)))
            found.append(np.unique(s[:, at:at + WINDOW]))
        rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
        columns = np.concatenate(found)
        values = ratios[columns]
        w, bias = np.zeros(slots + 1), 0.0
        seen, seen_bias = np.full(slots + 1, 1e-8), 1e-8
        for _ in range(ROUNDS):
            error = (sigmoid(np.bincount(rows, values * w[columns], minlength=len(y)) + bias) - y) * weight
            slope = 1e-4 / len(y) * w + np.bincount(columns, values * error[rows], minlength=slots + 1)
            seen += slope * slope
            seen_bias += error.sum() ** 2
            w -= RATE * slope / np.sqrt(seen)
            bias -= 10 * RATE * error.sum() / np.sqrt(seen_bias)
    return (w * ratios).astype(np.float32)


def train_toxicity(
    docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label: str = "toxic",
    per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, id: str = "doc_id", text: str = "text",
) -> ToxicityModel:
    """Fit on a label sample bounded by `per_class` rows of either label and `most_chars` characters of either; whole texts.

    Every n-gram counts with the logarithm of its smoothed frequency ratio between the
    classes. The sample falls into PARTS; the windows of each are summed by weights fitted
    without it, and on these sums the score is calibrated, the classes weighing by the roots of
    their shares. The weights kept are fitted on all. With fewer than two rows of a class
    the score is the share of label 1 (0.5 without labels).
    """
    apart = fold(F.col("_id"), FOLDS) == HELD_OUT if held_out is None else held_out
    sample, share = label_sample(docs, labels, label, apart, per_class, most_chars, id, text)
    y = np.array([k for _, k in sample], dtype=np.float64)
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return ToxicityModel(b"", (), (), (), (), (), share)
    texts = [slots_of(t) for t, _ in sample]
    part = np.zeros(len(y), dtype=int)
    for value in (0, 1):
        part[y == value] = np.arange((y == value).sum()) % PARTS
    raw = np.zeros((len(y), 6))
    for p in sorted(set(part.tolist())):
        weights = _fit([t for t, q in zip(texts, part) if q != p], y[part != p])
        for i in np.flatnonzero(part == p):
            raw[i] = measures(window_sums(texts[i], weights))
    roots = np.sqrt(share), np.sqrt(1 - share)
    mean, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-6
    calibration = fit_logistic(
        np.column_stack([(raw - mean) / scale, np.ones(len(raw))]), y, class_weights(y, roots[0] / sum(roots)), ridge=1.0)
    as_tuple = lambda a: tuple(map(float, a))
    return ToxicityModel(_fit(texts, y).tobytes(), as_tuple(calibration), as_tuple(mean), as_tuple(scale),
                         as_tuple(raw.min(axis=0)), as_tuple(raw.max(axis=0)), share)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row, repeated rows included; a null text counts as empty. One pass, no shuffle."""
    return with_toxicity(docs.select(id, text), model, "score", text).select(F.col(id).cast("bigint").alias(id), "score")


def with_toxicity(docs: DataFrame, model: ToxicityModel, column: str, text: str = "text") -> DataFrame:
    """The rows with their score of the whole text as one more column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = shared.value.scorer()
        for batch in batches:
            yield pd.Series(of(["" if t is None else t for t in batch]), dtype="float64")
        release()

    return docs.withColumn(column, score(F.col(text)))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows scored below the threshold, with their own columns only.

    Null and empty texts are scored as empty ones; every repeated row is judged alike and stays or
    goes with the others; ids are not read; an empty table stays empty.
    """
    named = "_toxicity"
    while named in docs.columns:
        named += "_"
    return with_toxicity(docs, model, named, text).where(F.col(named) < threshold).drop(named)
