"""Quality scores from a support vector machine on naive-Bayes-scaled n-gram indicators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .labelled import fold, per_text, score_table, sigmoid, training_sample

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 6000
DIM = 1 << 20
_NUMBERS = 4096  # the first features: buckets of simple shares

# Byte classes of the character n-grams: letters by case, digits, white space, every ASCII sign by itself.
_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123] = _CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2


def _bucket(kind: int, share: float) -> int:
    return kind * 64 + min(63, int(share * 32))


def features(column: pa.Array) -> list[np.ndarray]:
    """Indicators of each text: words and word pairs (A-Z folded), n-grams (1 to 5) of the run-compressed byte classes, and bucketed shares of repeated words and signs."""
    out = []
    for buf, h, lengths in per_text(column):
        n, words = len(buf), len(h)
        parts = [h >> np.uint64(44), W.grams(h, 2) >> np.uint64(44)]
        if n:
            c = _CLASS[buf]
            turn = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            runs, span = c[turn], np.minimum(np.diff(np.append(turn, n)), 3).astype(np.uint64)
            sign = runs * np.uint64(4) + np.where(runs > 2, span, 0).astype(np.uint64)
            g = sign
            for k in range(5):
                if k:
                    g = g[:-1] * np.uint64(1031) + sign[k:]
                if not len(g):
                    break
                parts.append((g * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 7919)) >> np.uint64(44))
        numbers = [_bucket(0, np.log2(words + 1) / 16)]
        if words:
            numbers += [
                _bucket(1, len(np.unique(h)) / words),
                _bucket(2, float((h[1:] == h[:-1]).mean()) if words > 1 else 0.0),
                _bucket(3, float((h[2:] == h[:-2]).mean()) if words > 2 else 0.0),
                _bucket(4, min(1.0, float(lengths.mean()) / 24)),
                _bucket(5, float(((buf >= 65) & (buf <= 90)).mean())),
                _bucket(6, float((_CLASS[buf] > 2).mean() - (buf == 32).mean())),
            ]
        ids = np.concatenate([p % np.uint64(DIM - _NUMBERS) for p in parts]).astype(np.int64) + _NUMBERS if parts else np.zeros(0, np.int64)
        out.append(np.unique(np.concatenate([np.array(numbers, dtype=np.int64), ids])))
    return out


class NaiveBayesSVM:
    """Log-count ratios r of the two classes, then w of a hinge-loss machine on r * indicator by dual coordinate descent."""

    def __init__(self, alpha: float = 1.0, c: float = 1.0, rounds: int = 12, seed: int = 5):
        self.alpha, self.c, self.rounds, self.seed = alpha, c, rounds, seed

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> "NaiveBayesSVM":
        """With one class, or no row, every score is that class's (0.5 without rows)."""
        self.weights, self.bias, self.slope, self.shift = np.zeros(DIM), 0.0, 0.0, 0.0
        if not len(y) or y.min() == y.max():
            share = y.mean() if len(y) else 0.5
            self.shift = float(np.clip(np.log((share + 1e-2) / (1 - share + 1e-2)), -4, 4))
            return self
        count = [np.full(DIM, self.alpha), np.full(DIM, self.alpha)]
        for f, t in zip(rows, y):
            count[int(t)][f] += 1
        ratio = np.log(count[1] / (2 * self.alpha + y.sum())) - np.log(count[0] / (2 * self.alpha + (1 - y).sum()))
        ratio[(count[0] + count[1] - 2 * self.alpha) < 2] = 0.0
        fitted = np.random.RandomState(self.seed).rand(len(y)) < 0.8  # the rest sets slope and shift of the scores
        if len(set(y[fitted])) < 2 or len(set(y[~fitted])) < 2 or len(y) < 50:
            fitted[:] = True
        self._descend([rows[i] for i in np.flatnonzero(fitted)], np.where(y[fitted] > 0, 1.0, -1.0), ratio)
        rest = ~fitted if not fitted.all() else fitted
        self._calibrate(np.array([self.margin(rows[i]) for i in np.flatnonzero(rest)]), y[rest])
        return self

    def _descend(self, rows, sign, ratio):
        values = [ratio[f] for f in rows]
        scale = 1.0 / np.mean([np.sqrt((v * v).sum()) + 1e-9 for v in values])
        values = [v * scale for v in values]
        square = np.array([(v * v).sum() + 1.0 for v in values])
        upper = self.c * np.where(sign > 0, 0.5 / (sign > 0).mean(), 0.5 / (sign < 0).mean())
        w, b, dual, order = np.zeros(DIM), 0.0, np.zeros(len(rows)), np.random.RandomState(self.seed)
        for _ in range(self.rounds):
            for i in order.permutation(len(rows)):
                g = sign[i] * (w[rows[i]] @ values[i] + b) - 1.0
                new = min(max(dual[i] - g / square[i], 0.0), upper[i])
                if new != dual[i]:
                    step = (new - dual[i]) * sign[i]
                    w[rows[i]] += step * values[i]
                    b += step
                    dual[i] = new
        self.weights, self.bias, self.dual, self.upper = w * ratio * scale, b, dual, upper

    def _calibrate(self, margin, y):
        """Platt's sigmoid by Newton steps with a small ridge."""
        a, b = 1.0, 0.0
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(60):
            p = sigmoid(a * margin + b)
            g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum() + 1e-3 * b])
            k = p * (1 - p) + 1e-9
            hess = np.array([[(k * margin * margin).sum() + 1e-3, (k * margin).sum()], [(k * margin).sum(), k.sum() + 1e-3]])
            move = np.linalg.solve(hess, g)
            a, b = a - np.clip(move[0], -2, 2), b - np.clip(move[1], -2, 2)
        self.slope, self.shift = max(a, 1e-3), b

    def margin(self, f: np.ndarray) -> float:
        return float(self.weights[f].sum() + self.bias)

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid(np.array([self.slope * self.margin(f) + self.shift for f in features(column)]))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; only the text is an input of a score.

    Fitted on at most ``rows`` documents with a ``quality`` label whose
    crc32(doc_id as text) mod 4 is not 2.  Null and empty texts have the score of a
    text without words.  Repeated rows have equal scores; a null doc_id is not
    held out.  Without usable labels every score is 0.5.
    """
    usable = fold(4) != 2
    found, y = training_sample(docs, labels, "quality", usable, rows, features)
    return score_table(docs, fold(4) == 2, NaiveBayesSVM().fit(found, y).score)
