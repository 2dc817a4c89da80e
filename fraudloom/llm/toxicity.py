"""Toxicity by a counterfactual-regularised classifier (operator 8).

A logistic model over the words of a text and their beginnings. In the labelled
sentences, identity terms are swapped for others of their group, and the model
pays for every change of its logit:

    log loss + fairness * mean((logit(text) - logit(swapped))^2) + decay * |w|^2

so that naming a group by itself moves no score, though such names may be more
frequent in toxic texts.

Features are chosen and weights fitted on at most ``per_class`` toxic and
``per_class`` other labelled documents, chosen by their ids' hashes; other sizes
of the classes are made up for by weights. Feature counts are summed on the
executors; the driver ranks the ``candidates`` most frequent ones of those that at
least ``least_documents`` toxic documents of the sample hold, keeps at most
``most_features`` and gets each sampled text's numbers of those. Scores cover every document, and use nothing but its
whole text.

Defined results: null and empty texts have no features and get the model's bias;
without labels of both classes every score is the share of toxic labels (0 if
there are none).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudloom.llm.common import FOLD, annotate, bytes_of, fresh, share
from fraudloom.llm.sampling import class_counts, hashed_sample, sampled_texts, training_labels

PER_CLASS = 20_000
CANDIDATES = 65_536
MOST_FEATURES = 4_096
LEAST_DOCUMENTS = 5
#: A feature must set the classes apart by this likelihood ratio (chi-squared, one degree).
LEAST_RATIO = 15.0
BEGINNINGS = (4, 5, 6)
_FLUSH = 200_000

#: Identity terms by group; any of a group may stand for any other of it.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("men", "women"), ("man", "woman"), ("boy", "girl"), ("boys", "girls"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "indian", "arab"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer"),
    ("deaf", "blind", "disabled", "autistic"), ("old", "young"), ("immigrant", "refugee", "native", "foreigner"),
    ("immigrants", "refugees", "natives", "foreigners"),
)


def words_of(data: bytes) -> list[str]:
    return [w for w in data.translate(FOLD).decode().split(" ") if w]


def feature_set(words: Iterable[str]) -> set[str]:
    """Words and beginnings of longer words; a beginning ends with a star."""
    own = set(words)
    return own.union(*({w[:k] + "*" for w in own if len(w) > k} for k in BEGINNINGS))


def swapped(words: list[str], identities: tuple[tuple[str, ...], ...]) -> list[list[str]]:
    """Copies of a text's words with the identity terms of one group replaced by its next and by its middle one."""
    out, present = [], set(words)
    for group in identities:
        if present.isdisjoint(group):
            continue
        for step in sorted({1, max(len(group) // 2, 1)}):
            turn = {t: group[(i + step) % len(group)] for i, t in enumerate(group)}
            out.append([turn.get(w, w) for w in words])
    return out


def _counted(sample: DataFrame, only: frozenset | None) -> DataFrame:
    """(feature, n): documents that hold each feature; with ``only``, of those features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in bytes_of(batch.column(0)):
                own = feature_set(words_of(t))
                counts.update(own if only is None else own & only)
                if len(counts) > _FLUSH:
                    yield _count_batch(counts)
                    counts = Counter()
        yield _count_batch(counts)

    return sample.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _count_batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])


def likelihood_ratio(a: float, b: float, n: float, m: float) -> float:
    """How strongly ``a`` of ``n`` and ``b`` of ``m`` speak against a common share."""

    def part(k: float, of: float, p: float) -> float:
        return (k * math.log(k / of / p) if k else 0.0) + ((of - k) * math.log((of - k) / of / (1 - p)) if of > k else 0.0)

    p = (a + b) / (n + m)
    return 0.0 if p in (0.0, 1.0) else 2 * (part(a, n, p) + part(b, m, p))


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def scores(self, texts: list[bytes]) -> list[float]:
        known = self.weights
        out = []
        for t in texts:
            z = self.bias + math.fsum(known[f] for f in known.keys() & feature_set(words_of(t)))
            out.append(1 / (1 + math.exp(-min(max(z, -40.0), 40.0))))
        return out


def fit(
    texts: list[list[int]], y: np.ndarray, weight: np.ndarray, swaps: list[tuple[list[int], list[int]]], width: int,
    fairness: float = 1.0, decay: float = 1e-4, steps: int = 500, rate: float = 0.1,
) -> tuple[np.ndarray, float]:
    """Weights and bias. ``texts`` lists feature numbers; ``swaps`` pairs of them before and after a swap."""

    def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], np.int64)

    row, col = flat(texts)
    pairs = [(flat([a for a, _ in swaps]), 1.0), (flat([b for _, b in swaps]), -1.0)] if swaps else []
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    total = weight.sum()
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], len(texts)) + w[-1]
        r = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight / total
        g = np.append(np.bincount(col, r[row], width), r.sum())
        if swaps:
            change = sum(sign * np.bincount(a, w[b], len(swaps)) for (a, b), sign in pairs)
            for (a, b), sign in pairs:
                g[:-1] += 2 * fairness / len(swaps) * sign * np.bincount(b, change[a], width)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, most_features: int = MOST_FEATURES,
    candidates: int = CANDIDATES, least_documents: int = LEAST_DOCUMENTS, fairness: float = 1.0, identities: tuple[tuple[str, ...], ...] = IDENTITIES, doc_id: str = "doc_id", text: str = "text",
) -> Model:
    """Choose features and fit on a bounded sample of the labelled documents that are not held out."""
    known = training_labels(labels, label, doc_id)
    sizes = class_counts(known)
    if len(sizes) < 2:
        share = min(max(float(sizes.get(1, 0) > 0), 1e-9), 1 - 1e-9)
        return Model(math.log(share / (1 - share)))
    sides = [hashed_sample(known.filter(F.col("label") == c), per_class) for c in (0, 1)]
    sample = sampled_texts(docs, sides[0].unionByName(sides[1]), doc_id, text)
    counts = class_counts(sample)
    n, m = counts.get(1, 0), counts.get(0, 0)
    if not n or not m:
        share = min(max(sizes[1] / (sizes[0] + sizes[1]), 1e-9), 1 - 1e-9)
        return Model(math.log(share / (1 - share)))
    toxic, other = sample.filter("label = 1"), sample.filter("label = 0")
    often = _counted(toxic, None).filter(F.col("n") >= least_documents).orderBy(F.desc("n"), "feature").limit(candidates).collect()
    seen = {r["feature"]: r["n"] for r in often}
    elsewhere = {r["feature"]: r["n"] for r in _counted(other, frozenset(seen)).collect()}
    ranked = sorted(
        ((likelihood_ratio(a, elsewhere.get(f, 0), n, m), f) for f, a in seen.items() if a / n > elsewhere.get(f, 0) / m),
        key=lambda x: (-x[0], x[1]),
    )
    chosen = [f for ratio, f in ranked[:most_features] if ratio >= LEAST_RATIO]
    number = {f: i for i, f in enumerate(chosen)}

    def numbered(texts: list[bytes]) -> Iterable[tuple]:
        for t in texts:
            words = words_of(t)
            own = sorted(number[f] for f in number.keys() & feature_set(words))
            others = [sorted(number[f] for f in number.keys() & feature_set(s)) for s in swapped(words, identities)]
            yield own, others

    rows = annotate(sample, "f", "own array<int>, swaps array<array<int>>", numbered).select("doc_id", "label", "f.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    y = np.array([r["label"] for r in rows], float)
    weight = np.where(y == 1, sizes[1] / n, sizes[0] / m)
    pairs = [(r["own"], s) for r in rows for s in r["swaps"] if s != r["own"]]
    w, bias = fit([r["own"] for r in rows], y, weight, pairs, len(chosen), fairness)
    return Model(bias, dict(zip(chosen, w.tolist())))


def score(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column ``.score``, whose name is returned too."""
    name, shared = fresh(docs, "toxicity"), share(docs.sparkSession, model)
    return annotate(docs, name, "score double", lambda texts: ((s,) for s in shared().scores(texts)), text), name
