"""Quality classifier: how well dictionaries of good and of bad text compress a document."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import class_weights, fit_logistic, fold, id_and_text, label_sample, map_texts, sigmoid

DICTIONARY_BYTES = 1 << 16
LEVEL = 3
PIECE = 1024
PER_CLASS = 2_000
MOST_CHARS = 8_000_000
PARTS = 4
# Bytes added to a text's length: what a frame takes of its own counts little.
DAMPED = 100
FOLDS = 5
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration of the compressed-size difference."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    base: float

    def scorer(self):
        if not self.weights:
            return lambda texts: np.full(len(texts), self.base)
        measure = _measure(self.good, self.bad)
        w = np.array(self.weights)

        def score(texts: list[str]) -> np.ndarray:
            raw = np.array([measure(t) for t in texts]).reshape(len(texts), -1)
            return sigmoid(_expand(np.clip(raw, self.low, self.high), self.mean, self.scale) @ w)

        return score


def _measure(good: bytes, bad: bytes):
    """text -> the normalised difference of its sizes under both dictionaries, of the whole and of its worst and best piece, and
    how far the good one compresses it, damped for short texts. Pieces keep the dictionaries in reach of long texts.
    """
    def compressor(content: bytes):
        kind = zstandard.DICT_TYPE_AUTO
        data = zstandard.ZstdCompressionDict(content, dict_type=kind)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False)

    by_good, by_bad = compressor(good), compressor(bad)

    def measure(text: str) -> tuple[float, ...]:
        raw = text.encode("utf-8", "replace")
        a = b = 0
        least, most = 1.0, -1.0
        for start in range(0, max(1, len(raw)), PIECE):
            piece = raw[start:start + PIECE]
            u, v = len(by_good.compress(piece)), len(by_bad.compress(piece))
            a, b = a + u, b + v
            gap = (v - u) / (u + v)
            least, most = min(least, gap), max(most, gap)
        return (b - a) / (a + b), least, most, a / (len(raw) + DAMPED)

    return measure


def _expand(raw: np.ndarray, mean, scale) -> np.ndarray:
    """Standardised measures, their products and a constant."""
    z = (raw - np.array(mean)) / np.array(scale)
    pairs = [z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i + 1)]
    return np.column_stack([z, *pairs, np.ones(len(z))])


def _dictionary(texts: list[str]) -> bytes:
    raw = [t.encode("utf-8", "replace") for t in texts]
    pieces = [r[i:i + 512] for r in raw for i in range(0, len(r), 512)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself is the dictionary
        return b"\n".join(raw)[-DICTIONARY_BYTES:] or b"\n" * 8


def train_quality(
    docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label: str = "quality",
    per_class: int = PER_CLASS, most_chars: int = MOST_CHARS, id: str = "doc_id", text: str = "text",
) -> QualityModel:
    """Dictionaries from the label sample, calibrated on texts they were not made from.

    The sample is bounded by `per_class` rows of either label and `most_chars`
    characters of either; whole texts are used. It falls into PARTS; each part is measured
    by dictionaries of the others, which gives the calibration as many texts as there
    are. The dictionaries kept are those of all. With one class only, or none, or too few
    rows to leave a part out, the score is the share of label 1 (0.5 without labels).
    """
    apart = fold(F.col("_id"), FOLDS) == 0 if held_out is None else held_out
    sample, share = label_sample(docs, labels, label, apart, per_class, most_chars, id, text)
    y = np.array([k for _, k in sample])
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return QualityModel(b"", b"", (), (), (), (), (), share)
    part = np.zeros(len(y), dtype=int)
    for value in (0, 1):  # both classes in every part, as far as they go
        part[y == value] = np.arange((y == value).sum()) % PARTS

    def dictionaries(apart: int | None) -> tuple[bytes, bytes]:
        kept = [(t, k) for (t, k), p in zip(sample, part) if p != apart]
        return tuple(_dictionary([t for t, k in kept if k == v]) for v in (1, 0))

    raw = np.zeros((len(y), 4))
    for p in sorted(set(part.tolist())):
        measure = _measure(*dictionaries(p))
        for i in np.flatnonzero(part == p):
            raw[i] = measure(sample[i][0])
    good, bad = dictionaries(None)
    mean, scale = raw.mean(axis=0), raw.std(axis=0) + 1e-6
    weights = fit_logistic(_expand(raw, mean, scale), y, class_weights(y, share), ridge=0.3)
    as_tuple = lambda a: tuple(map(float, a))
    return QualityModel(good, bad, as_tuple(weights), as_tuple(mean), as_tuple(scale),
                        as_tuple(raw.min(axis=0)), as_tuple(raw.max(axis=0)), share)


def score_quality(docs: DataFrame, model: QualityModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every row, repeated rows included.

    The whole text is compressed. A null text counts as empty; an empty or extreme
    text is scored at the edge of what the calibration has seen. One pass, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = shared.value.scorer()
        return lambda texts: {"score": score(texts)}

    scored = map_texts(id_and_text(docs, id, text), make, "score double")
    return scored.withColumnRenamed("_id", id)
