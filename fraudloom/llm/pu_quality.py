"""Quality classifier by positive-unlabelled learning (operator 2).

Trusted good documents are the positives, documents without a label the
unlabelled; labels of bad ones are not used. If none lacks a label, all documents
but the held-out ones are the unlabelled, their labels unread. A first classifier tells positives
from unlabelled; from its scores the share of good documents among the unlabelled
(the class prior) is estimated, as the least ratio of unlabelled to positive mass
above a score. The final logistic model minimises the non-negative unbiased risk

    prior * R(positive as good) + max(0, R(unlabelled as bad) - prior * R(positive as bad))

whose second part is kept from going below zero, so that it cannot overfit by
pushing unlabelled documents down without end.

The model is fitted on at most ``per_side`` positives and ``per_side`` unlabelled
documents, chosen by their ids' hashes; only their features reach the driver
(some MB). Scores cover every document and use nothing but its whole text.

Defined results: null and empty texts are scored as texts without words; without
positives all scores are 1 (nothing speaks against any).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.llm.common import annotate, fresh, held_out
from fraudloom.llm.sampling import hashed_sample, sampled_texts, training_labels

PER_SIDE = 20_000
_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_CAPITALS = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_ODD = b"#*$%&|<>{}[]\\^~_@"
_MARKS = b"!?"


def features(data: bytes) -> list[float]:
    """Numbers that describe a whole text: shape of its words, symbols, repetition."""
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(NAMES)
    letters = size - len(data.translate(None, _LETTERS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    threes = list(zip(words, words[1:], words[2:]))
    beside = sum(map(bytes.__eq__, words, words[1:]))
    longest, run = 1, 1
    if beside:
        for a, b in zip(words, words[1:]):
            run = run + 1 if a == b else 1
            longest = max(longest, run)
    shapes = [
        math.log1p(n),
        size / n,
        (size - len(data.translate(None, _CAPITALS))) / max(letters, 1),
        (size - len(data.translate(None, _DIGITS))) / size,
        math.log1p(100 * (size - len(data.translate(None, _ODD))) / size),
        math.log1p(100 * (size - len(data.translate(None, _MARKS))) / size),
        data.count(b"|") / n,
        letters / size,
        len(set(words)) / n ** 0.9,
        beside / n,
        math.log(longest),
        1 - len(set(threes)) / len(threes) if threes else 0.0,
        1 - len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        len(zlib.compress(data, 1)) / (size + 20),
        sum(w.isupper() for w in words) / n,
    ]
    return shapes


NAMES = (
    "log_words", "bytes_per_word", "capitals", "digits", "odd_symbols", "marks", "bars", "letters", "distinct_words",
    "beside", "longest_run", "repeated_threes", "repeated_lines", "words_per_line", "compressed", "capital_words",
)


@dataclass(frozen=True)
class Model:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -8, 8)
        return 1 / (1 + np.exp(-np.clip(_expand(z) @ np.array(self.weights) + self.bias, -40, 40)))


def _expand(z: np.ndarray) -> np.ndarray:
    """Standardised features and how far each lies above and below the usual."""
    return np.hstack([z, np.maximum(z - 1.5, 0), np.maximum(-z - 1.5, 0)])


def _descend(gradient, width: int, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Adam on a full gradient."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: least ratio of their masses above a score, with a margin for chance."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.9, 181)))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(4 / 0.1) / 2) * (1 / math.sqrt(len(positive)) + 1 / math.sqrt(len(unlabelled)))
    best = np.argmin((u + margin) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, decay: float = 1e-3) -> Model:
    """Estimate the prior and minimise the non-negative unbiased risk on feature rows."""
    both = np.vstack([positive, unlabelled])
    mean, scale = np.median(both, axis=0), both.std(axis=0) + 1e-6
    p, u = (np.hstack([_expand(np.clip((x - mean) / scale, -8, 8)), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    width = p.shape[1]
    keep = np.append(np.ones(width - 1), 0.0)

    def apart(w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return -a.T @ (1 - _sigmoid(a @ w)) / len(a) + b.T @ _sigmoid(b @ w) / len(b) + decay * w * keep

    # every other row, so that rows in some order of theirs are shared out alike
    first = _descend(lambda w: apart(w, p[::2], u[::2]), width, 300)
    prior = class_prior(p[1::2] @ first, u[1::2] @ first)

    def risk(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        as_good = -p.T @ (1 - sp) / len(p)
        rest = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        as_bad = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        # below zero the second part is walked back instead of followed
        return decay * w * keep + (prior * as_good + as_bad if rest >= 0 else -as_bad)

    w = _descend(risk, width)
    return Model(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w[:-1].tolist()), float(w[-1]), prior)


def _featured(texts: list[bytes]) -> Iterable[tuple]:
    return ((features(t),) for t in texts)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_side: int = PER_SIDE, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """Fit on bounded samples of positives and unlabelled documents; None if either is missing."""
    known = training_labels(labels, label, doc_id)
    positives = hashed_sample(known.filter("label = 1"), per_side)
    fold = docs.filter(F.col(doc_id).isNotNull() & ~held_out(doc_id)).select(F.col(doc_id).alias("doc_id"))
    free = fold.join(labels.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_anti")

    def featured(ids: DataFrame) -> list:
        unlabelled = hashed_sample(ids.distinct(), per_side).withColumn("label", F.lit(0))
        texts = sampled_texts(docs, positives.unionByName(unlabelled), doc_id, text)
        return annotate(texts, "f", "x array<double>", _featured).select("doc_id", "label", "f.x").orderBy(F.xxhash64("doc_id"), "doc_id").collect()

    rows = featured(free)
    if rows and all(r["label"] == 1 for r in rows):
        rows = featured(fold)
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    if not len(x) or not (y == 1).any() or not (y == 0).any():
        return None
    return fit(x[y == 1], x[y == 0])


def score(docs: DataFrame, model: Model | None, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column ``.score``, whose name is returned too."""
    name = fresh(docs, "quality")

    def rows(texts: list[bytes]) -> Iterable[tuple]:
        if model is None:
            return ((1.0,) for _ in texts)
        return ((s,) for s in model.scores(np.array([features(t) for t in texts])).tolist()) if texts else ()

    return annotate(docs, name, "score double", rows, text), name
