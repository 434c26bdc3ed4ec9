"""Toxicity scores from a logistic model that is pulled to equal scores for swapped identity terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .labelled import fold, per_text, score_table, sigmoid, training_sample

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 20_000
DIM = 1 << 20

# Identity terms, each group's terms stand for one another in a counterfactual.
IDENTITY_TERMS = (
    ("women", "men", "woman", "man", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "schwarze", "weiße", "noirs", "blancs", "negros", "blancos"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "homosexual", "heterosexual", "transgender", "trans"),
    ("immigrants", "natives", "refugees", "foreigners", "citizens", "einwanderer", "flüchtlinge", "ausländer", "immigrés", "réfugiés", "étrangers", "inmigrantes", "refugiados", "extranjeros"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young", "old"),
)


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def features(column: pa.Array) -> list[np.ndarray]:
    """The distinct bare words of each text, A-Z folded, as feature numbers."""
    return [np.unique(_feature(h)) for _, h, _ in per_text(column, bare=True)]


class CounterfactualLogit:
    """Logistic regression; penalty ``swap`` times the squared change of the logit when identity terms are swapped."""

    def __init__(self, ridge: float = 0.005, swap: float = 5.0, least: int = 3, z: float = 3.0, steps: int = 600):
        self.ridge, self.swap, self.least, self.z, self.steps = ridge, swap, least, z, steps

    def fit(self, rows: list[np.ndarray], y: np.ndarray) -> "CounterfactualLogit":
        """Words that speak for toxicity by their log-odds are kept; identity terms always are, so that swapping them has its penalty."""
        self.keys, self.w, self.bias = np.zeros(0, np.int64), np.zeros(0), 0.0
        if not len(y) or y.min() == y.max():
            share = y.mean() if len(y) else 0.5
            self.bias = float(np.clip(np.log((share + 1e-2) / (1 - share + 1e-2)), -4, 4)) if len(y) else 0.0
            return self
        groups = [np.unique(_feature(W.hashes_of(list(g)))) for g in IDENTITY_TERMS]
        n1, n0 = y.sum(), (1 - y).sum()
        c1 = np.bincount(np.concatenate([r for r, t in zip(rows, y) if t]), minlength=DIM)
        c0 = np.bincount(np.concatenate([r for r, t in zip(rows, y) if not t]), minlength=DIM)
        a, b = c1 + 0.5, c0 + 0.5
        odds = np.log(a / (n1 - c1 + 0.5)) - np.log(b / (n0 - c0 + 0.5))
        z = odds / np.sqrt(1 / a + 1 / b + 1 / (n1 - c1 + 0.5) + 1 / (n0 - c0 + 0.5))
        self.keys = np.union1d(np.flatnonzero((c1 + c0 >= self.least) & (z >= self.z)), np.concatenate(groups))
        self.keys = self.keys.astype(np.int64)
        at = [self._known(r) for r in rows]
        who, what = np.repeat(np.arange(len(at)), [len(f) for f in at]), np.concatenate(at)
        plus, minus, pair = self._swaps(at, groups)
        m = len(self.keys)
        weight = np.where(y > 0, max(1.0, n0 / n1), 1.0)  # both classes weigh alike
        self.w, self.bias = np.zeros(m), 0.0
        step = np.array([np.zeros(m + 1), np.zeros(m + 1)])
        for k in range(1, self.steps + 1):
            p = sigmoid(np.bincount(who, self.w[what], len(y)) + self.bias)
            off = weight * (p - y)
            g = np.bincount(what, off[who], m) + self.ridge * self.w * len(y) / 100
            if pair:
                change = np.bincount(plus[0], self.w[plus[1]], pair) - np.bincount(minus[0], self.w[minus[1]], pair)
                g += self.swap * (np.bincount(plus[1], change[plus[0]], m) - np.bincount(minus[1], change[minus[0]], m))
            g = np.append(g, off.sum()) / len(y)
            step[0] = 0.9 * step[0] + 0.1 * g
            step[1] = 0.999 * step[1] + 0.001 * g * g
            move = 0.1 * (step[0] / (1 - 0.9**k)) / (np.sqrt(step[1] / (1 - 0.999**k)) + 1e-8)
            self.w, self.bias = self.w - move[:-1], self.bias - move[-1]
        return self

    def _known(self, f: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, f)
        at[at == len(self.keys)] = 0
        return at[self.keys[at] == f] if len(self.keys) else at[:0]

    def _swaps(self, at, groups):
        """For each labelled text with identity terms and each other term of the group: the terms removed and the one put in."""
        plus, minus, pair = ([], []), ([], []), 0
        places = [self._known(g) for g in groups]
        for f in at:
            for place in places:
                mine = np.intersect1d(f, place)
                for other in np.setdiff1d(place, mine) if len(mine) else ():
                    for i in mine:
                        minus[0].append(pair)
                        minus[1].append(i)
                    plus[0].append(pair)
                    plus[1].append(other)
                    pair += 1
        to = lambda x: (np.array(x[0], dtype=np.int64), np.array(x[1], dtype=np.int64))
        return to(plus), to(minus), pair

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid(np.array([self.w[self._known(f)].sum() + self.bias for f in features(column)]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; only the text is an input of a score.

    Fitted on at most ``rows`` documents with a ``toxic`` label whose
    crc32(doc_id as text) mod 3 is not 1.  Null and empty texts have the score of a
    text without words.  Repeated rows have equal scores; a null doc_id is not
    held out.  Without usable labels every score is 0.5.
    """
    found, y = training_sample(docs, labels, "toxic", fold(3) != 1, rows, features)
    return score_table(docs, fold(3) == 1, CounterfactualLogit().fit(found, y).score)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns kept."""
    found, y = training_sample(docs, labels, "toxic", fold(3) != 1, TRAIN_ROWS, features)
    model = CounterfactualLogit().fit(found, y)

    def run(batches):
        for batch in batches:
            s = model.score(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(s < 0.7))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(W.tidy(run), docs.schema)
