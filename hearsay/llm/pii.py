"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds what they miss.

Base spans of four kinds come from patterns with checks. A bidirectional LSTM over
character classes with CRF transitions, trained in numpy from labelled spans, reads
the same text in overlapping windows; spans decoded in all windows are reconciled
over the whole text and added where they meet no base span. Each of the four kinds
needs a digit or an at sign, and a decoded span without one is dropped, so text
further than CONTEXT characters from any of these need not be read: no window of it
could add a span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import id_and_text, map_texts

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 24
WINDOW, STRIDE = 64, 32
HIDDEN = 12
TRAIN_DOCS, WINDOWS_PER_DOC, TRAIN_WINDOWS = 1_500, 12, 3_000
STEPS, BATCH, RATE = 400, 64, 0.03
CONFIDENCE = 0.95
# Digits that a decoded span of each kind has at least: an address needs none.
LEAST_DIGITS = (0, 4, 12, 9)

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_SEED = re.compile(r"[0-9@]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: what stands before an at sign begins where its run does."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Pattern matches that pass their checks, by start and kind."""
    if not _SEED.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [
        (m.start(), 1, m.end()) for m in _IP.finditer(text)
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
    ]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def to_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


# --- characters, windows and tags ------------------------------------------------------------

_MARKS = "\n @.-+()_%,:;/!?\"'#$&*|<>=[]{}\\~^`\t"
PAD, LOWER, UPPER, DIGIT, OTHER = range(5)
CLASSES = 5 + len(_MARKS)
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def _class_table() -> np.ndarray:
    table = np.full(128, OTHER, dtype=np.int64)
    for code in range(128):
        c = chr(code)
        if c.isdigit():
            table[code] = DIGIT
        elif c.isalpha():
            table[code] = LOWER if c.islower() else UPPER
        elif c in _MARKS:
            table[code] = 5 + _MARKS.index(c)
    return table


_TABLE = _class_table()


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], OTHER)


def window_starts(text: str) -> list[int]:
    """Starts of overlapping windows over the stretches near digits and at signs."""
    stretches: list[list[int]] = []
    for m in _SEED.finditer(text):
        low, high = max(0, m.start() - CONTEXT), m.start() + CONTEXT
        if stretches and low <= stretches[-1][1]:
            stretches[-1][1] = high
        else:
            stretches.append([low, high])
    return [s for low, high in stretches for s in range(low, max(low + 1, high - WINDOW + STRIDE), STRIDE)]


def cut_windows(classes: np.ndarray, starts: list[int]) -> np.ndarray:
    padded = np.concatenate([classes, np.full(WINDOW, PAD)])
    return padded[np.array(starts)[:, None] + np.arange(WINDOW)[None, :]]


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length + WINDOW, dtype=np.int64)
    for start, kind, end in spans:
        tags[start], tags[start + 1:end] = 1 + 2 * kind, 2 + 2 * kind
    return tags


# --- the model -------------------------------------------------------------------------------

def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, a large penalty where not."""
    ban = np.zeros((TAGS, TAGS))
    for after in range(2, TAGS, 2):
        ban[:, after] = -1e4
        ban[after - 1:after + 1, after] = 0.0
    return ban


@dataclass
class Tagger:
    """Weights by name: fx fh fb (forward), gx gh gb (backward), o ob (tags), t (transitions), s (start)."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 3) -> Tagger:
        source, h = np.random.default_rng(seed), HIDDEN
        w = {}
        for side in "fg":
            w[side + "x"] = source.normal(0, 0.3, (CLASSES, 4 * h))
            w[side + "h"] = source.normal(0, 0.3, (h, 4 * h))
            w[side + "b"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        w["o"], w["ob"] = source.normal(0, 0.3, (2 * h, TAGS)), np.zeros(TAGS)
        w["t"], w["s"] = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
        return cls(w)

    def _pass(self, x: np.ndarray, side: str):
        """Hidden states (time, rows, hidden) and what the way back needs."""
        w, h = self.weights, HIDDEN
        gates_in = w[side + "x"][x.T] + w[side + "b"]
        state, cell, kept = np.zeros((len(x), h)), np.zeros((len(x), h)), []
        out = np.zeros((x.shape[1], len(x), h))
        for t in range(x.shape[1]):
            z = gates_in[t] + state @ w[side + "h"]
            i, f, o = np.split(_sigmoid(z[:, :3 * h]), 3, axis=1)
            g = np.tanh(z[:, 3 * h:])
            before, cell = (state, cell), f * cell + i * g
            bent = np.tanh(cell)
            state = o * bent
            out[t] = state
            kept.append((before, i, f, o, g, bent))
        return out, kept

    def emissions(self, x: np.ndarray, keep: bool = False):
        ahead, kept_f = self._pass(x, "f")
        back, kept_g = self._pass(x[:, ::-1], "g")
        both = np.concatenate([ahead, back[::-1]], axis=2)
        scores = both @ self.weights["o"] + self.weights["ob"]
        return (scores, both, kept_f, kept_g) if keep else scores

    def _crf(self, e: np.ndarray):
        """Forward and backward log sums (time, rows, tags) and log partition."""
        trans = self.weights["t"] + _allowed()
        start = self.weights["s"] + np.where(np.arange(TAGS) % 2 == 0, np.where(np.arange(TAGS) > 0, -1e4, 0.0), 0.0)
        steps = len(e)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[0] = start + e[0]
        for t in range(1, steps):
            alpha[t] = _log_sum(alpha[t - 1][:, :, None] + trans[None], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = _log_sum(trans[None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, _log_sum(alpha[-1], 1), trans

    def marginals(self, e: np.ndarray) -> np.ndarray:
        alpha, beta, total, _ = self._crf(e)
        return np.exp(alpha + beta - total[None, :, None])

    def best(self, e: np.ndarray) -> np.ndarray:
        """(rows, time) best tags."""
        trans = self.weights["t"] + _allowed()
        score = self.weights["s"] + np.where((np.arange(TAGS) % 2 == 0) & (np.arange(TAGS) > 0), -1e4, 0.0) + e[0]
        came = []
        for t in range(1, len(e)):
            step = score[:, :, None] + trans[None]
            came.append(step.argmax(axis=1))
            score = step.max(axis=1) + e[t]
        tags = [score.argmax(axis=1)]
        for back in reversed(came):
            tags.append(back[np.arange(len(back)), tags[-1]])
        return np.stack(tags[::-1], axis=1)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags and its slope in every weight."""
        n, steps = x.shape
        e, both, kept_f, kept_g = self.emissions(x, keep=True)
        alpha, beta, total, trans = self._crf(e)
        rows, gold = np.arange(n), y.T
        slope = np.exp(alpha + beta - total[None, :, None])
        path = self.weights["s"][y[:, 0]] + e[np.arange(steps)[:, None], rows[None, :], gold].sum(axis=0)
        path = path + trans[y[:, :-1], y[:, 1:]].sum(axis=1)
        g = {"s": slope[0].sum(axis=0), "t": np.zeros((TAGS, TAGS))}
        np.subtract.at(g["s"], y[:, 0], 1.0)
        for t in range(steps - 1):
            pair = alpha[t][:, :, None] + trans[None] + (e[t + 1] + beta[t + 1])[:, None, :] - total[:, None, None]
            g["t"] += np.exp(pair).sum(axis=0)
        np.subtract.at(g["t"], (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
        slope[np.arange(steps)[:, None], rows[None, :], gold] -= 1.0
        g["o"] = np.einsum("tnh,tnk->hk", both, slope)
        g["ob"] = slope.sum(axis=(0, 1))
        down = slope @ self.weights["o"].T
        g |= self._back(x, down[:, :, :HIDDEN], kept_f, "f")
        g |= self._back(x[:, ::-1], down[::-1, :, HIDDEN:], kept_g, "g")
        return float((total - path).mean()), {k: v / n for k, v in g.items()}

    def _back(self, x: np.ndarray, down: np.ndarray, kept: list, side: str) -> dict[str, np.ndarray]:
        wh, h = self.weights[side + "h"], HIDDEN
        gh, gates = np.zeros_like(wh), np.zeros((x.shape[1], len(x), 4 * h))
        d_state, d_cell = np.zeros((len(x), h)), np.zeros((len(x), h))
        for t in range(x.shape[1] - 1, -1, -1):
            (state, cell), i, f, o, g, bent = kept[t]
            dh = down[t] + d_state
            dc = d_cell + dh * o * (1 - bent ** 2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - g ** 2)], axis=1)
            gates[t] = dz
            gh += state.T @ dz
            d_state, d_cell = dz @ wh.T, dc * f
        flat = gates.reshape(-1, 4 * h)
        gx = np.eye(CLASSES)[x.T.ravel()].T @ flat
        return {side + "x": gx, side + "h": gh, side + "b": flat.sum(axis=0)}


def _log_sum(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis=axis, keepdims=True)
    return np.log(np.exp(z - top).sum(axis=axis)) + top.squeeze(axis)


def fit_tagger(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Tagger:
    """Adam over shuffled batches of windows, pass after pass; the same windows give the same weights."""
    model, source = Tagger.fresh(), np.random.default_rng(11)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    while step < steps:
        order = source.permutation(len(x))
        for a in range(0, len(order), BATCH):
            if step == steps:
                break
            some = order[a:a + BATCH]
            _, slope = model.gradient(x[some], y[some])
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            size = np.sqrt(sum(float((v * v).sum()) for v in slope.values()))
            for k, v in slope.items():
                v = v * min(1.0, 5.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                model.weights[k] = model.weights[k] - rate * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def train_tagger(docs: DataFrame, id: str = "doc_id", text: str = "text", steps: int = STEPS) -> Tagger | None:
    """Fit on windows whose labels are the base spans; None if the sample holds no span.

    The sample is bounded: TRAIN_DOCS documents with a digit or an at sign, by hash of
    their id, WINDOWS_PER_DOC windows of each by hash of their place, TRAIN_WINDOWS in all.
    """
    rows = id_and_text(docs, id, text).where(F.col("_text").rlike("[0-9@]") & F.col("_id").isNotNull())
    ids = [r["_id"] for r in rows.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_DOCS).collect()]
    if not ids:
        return None
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "_id bigint"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t in zip(batch["_id"], batch["_text"]):
                classes, tags = classes_of(t), tags_of(len(t), base_spans(t))
                starts = sorted(window_starts(t), key=lambda s: (s * 2654435761) % 4294967296)[:WINDOWS_PER_DOC]
                for s, x in zip(starts, cut_windows(classes, starts)):
                    y = tags[s:s + WINDOW].copy()
                    if y[0] and y[0] % 2 == 0:  # the window begins inside a span
                        y[0] -= 1
                    out.append((i, s, x.astype(np.uint8).tobytes(), y.astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["i", "s", "x", "y"]).astype({"i": "int64", "s": "int64"})

    windows = rows.join(chosen, "_id").mapInPandas(cut, "i bigint, s bigint, x binary, y binary")
    sample = windows.orderBy(F.xxhash64("i", "s"), "i", "s", "x").limit(TRAIN_WINDOWS).collect()
    x = np.array([np.frombuffer(r["x"], np.uint8) for r in sample], dtype=np.int64)
    y = np.array([np.frombuffer(r["y"], np.uint8) for r in sample], dtype=np.int64)
    return fit_tagger(x, y, steps) if len(y) and y.any() else None


def _spans_in(tags: np.ndarray, sure: np.ndarray, offset: int) -> Iterator[tuple[float, Span]]:
    """Spans of one window with the least marginal of their characters."""
    t = 0
    while t < len(tags):
        if tags[t] % 2 == 1:
            end = t + 1
            while end < len(tags) and tags[end] == tags[t] + 1:
                end += 1
            yield float(sure[t:end].min()), (offset + t, (int(tags[t]) - 1) // 2, offset + end)
            t = end
        else:
            t += 1


def decode(model: Tagger, texts: list[str]) -> list[list[Span]]:
    """Spans of whole texts, reconciled over their windows.

    A span cut by the edge of a window is left to the window that holds it whole
    (one longer than a window to none); of overlapping spans the surer one stays,
    then the longer, then the first.
    """
    starts = [window_starts(t) for t in texts]
    owners = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    found: list[list[tuple[float, Span]]] = [[] for _ in texts]
    if len(owners):
        x = np.concatenate([cut_windows(classes_of(t), s) for t, s in zip(texts, starts) if s])
        offsets = np.concatenate([np.array(s) for s in starts if s])
        for a in range(0, len(x), 2048):
            e = model.emissions(x[a:a + 2048])
            tags, sure = model.best(e), model.marginals(e)
            for k in np.flatnonzero(tags.any(axis=1)):
                owner, offset, length = owners[a + k], int(offsets[a + k]), len(texts[owners[a + k]])
                own = sure[np.arange(WINDOW), k, tags[k]]
                for p, span in _spans_in(tags[k], own, offset):
                    whole = (span[0] > offset or offset == 0) and span[2] < offset + WINDOW or span[2] == length
                    if whole and span[2] <= length:
                        found[owner].append((p, span))
    return [_reconcile(spans) for spans in found]


def _reconcile(spans: list[tuple[float, Span]]) -> list[Span]:
    kept: list[Span] = []
    for p, (start, kind, end) in sorted(set(spans), key=lambda s: (-s[0], s[1][0] - s[1][2], s[1])):
        if p >= CONFIDENCE and all(end <= k[0] or start >= k[2] for k in kept):
            kept.append((start, kind, end))
    return sorted(kept)


def added_spans(text: str, base: list[Span], decoded: list[Span]) -> list[Span]:
    """Decoded spans that meet no base span and hold what their kind needs."""
    out = []
    for start, kind, end in decoded:
        raw = text[start:end]
        digits = len(_NOT_DIGIT.sub("", raw))
        fits = "@" in raw if kind == 0 else digits >= LEAST_DIGITS[kind]
        if fits and all(end <= b[0] or start >= b[2] for b in base):
            out.append((start, kind, end))
    return out


def find_personal_data(docs: DataFrame, model: Tagger | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans of all, n_added.

    Positions are code points, end exclusive. A null text counts as empty; repeated
    rows report each for themselves. Without a model there are base spans only. One
    pass over whole texts, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str]) -> dict:
        base = [base_spans(t) for t in texts]
        near = decode(shared.value, texts) if shared.value else [[] for _ in texts]
        more = [added_spans(t, b, d) for t, b, d in zip(texts, base, near)]
        out = {f"n_{kind}": [sum(s[1] == k for s in b) for b in base] for k, kind in enumerate(KINDS)}
        out["base_sha256"] = [hashlib.sha256(to_text(b).encode()).hexdigest() for b in base]
        out["spans"] = [to_text(b + m) for b, m in zip(base, more)]
        out["n_added"] = [len(m) for m in more]
        return out

    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    found = map_texts(id_and_text(docs, id, text), lambda: work, f"{counts}, base_sha256 string, spans string, n_added bigint")
    return found.withColumnRenamed("_id", id)
