"""Toxicity by FTRL-proximal logistic regression (operator 3).

Features of a text are the presence of its hashed words, word stems (first bytes, so that inflected forms meet), pairs of
neighbours and pairs that skip one or two words.
Every coordinate has its own learning rate, and L1 keeps most weights at exactly zero, so the model
that goes to the executors is a short list of (feature, weight), at most ``DIMENSIONS`` of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import labelled
from tidemark.llm.wordbuf import Texts, mix

BITS = 20
STEMS = (4, 6)
DIMENSIONS = 1 << BITS
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


@dataclass(frozen=True)
class Ftrl:
    """Learning parameters.  The sample is bounded by ``max_rows`` documents; of these, so many as have
    ``max_features`` features together are gone through ``epochs`` times, any others once."""

    alpha: float = 6.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 6
    max_rows: int = 12_000
    max_features: int = 20_000_000
    threshold: float = 0.7


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(text number, feature) of every n-gram and skip-gram occurrence of a run of texts, and their number of texts."""
    t = Texts.of(pc.utf8_lower(column))
    start, end = (x.copy() for x in t.spans)
    if len(start):
        for _ in range(4):  # marks around a word are not part of it, unless it is all marks
            start += _PUNCTUATION[t.data[start]] & (end - start > 1)
            end -= _PUNCTUATION[t.data[end - 1]] & (end - start > 1)
    w, owner, out, who = t.hash_spans(start, end), t.word_text, [], []
    for skip in range(4):  # the word alone, its neighbour, one skipped, two skipped
        if skip:
            ok = owner[skip:] == owner[:-skip]
            h = mix(w[:-skip][ok] * np.uint64(0x9E3779B97F4A7C15) + w[skip:][ok] + np.uint64(skip)) if len(w) > skip else w[:0]
            who.append(owner[skip:][ok] if len(w) > skip else owner[:0])
        else:
            h = w
            who.append(owner)
        out.append((h >> np.uint64(64 - BITS)).astype(np.int64))
    for k in STEMS:
        longer = np.flatnonzero(end - start > k)
        who.append(owner[longer])
        out.append((mix(t.hash_spans(start[longer], start[longer] + k) + np.uint64(100 + k)) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(who), np.concatenate(out), t.n


class Learner:
    def __init__(self, p: Ftrl):
        self.p, self.z, self.n, self.bias = p, np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(2)

    def _weight(self, z, n, l1):
        p = self.p
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))

    def update(self, f: np.ndarray, y: float) -> None:
        z, n, b = self.z[f], self.n[f], self.bias
        w, wb = self._weight(z, n, self.p.l1), float(self._weight(b[0], b[1], 0.0))
        g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - y
        root = np.sqrt(n + g * g)
        self.z[f], self.n[f] = z + g - (root - np.sqrt(n)) / self.p.alpha * w, n + g * g
        b[0], b[1] = b[0] + g - (np.sqrt(b[1] + g * g) - np.sqrt(b[1])) / self.p.alpha * wb, b[1] + g * g

    def model(self) -> dict:
        w = self._weight(self.z, self.n, self.p.l1)
        at = np.flatnonzero(w)
        return {"at": at.astype(np.int32), "w": w[at].astype(np.float32), "bias": float(self._weight(self.bias[0], self.bias[1], 0.0))}


def _learn(p: Ftrl):
    def learn(stream: Iterator[tuple[pa.Array, np.ndarray]]) -> bytes:
        learner, kept, held = Learner(p), [], 0
        for column, ys in stream:
            who, f, n = features(column)
            key = np.unique(who * DIMENSIONS + f)
            cuts = np.searchsorted(key, np.arange(n + 1) * DIMENSIONS)
            f = (key & (DIMENSIONS - 1)).astype(np.int32)
            for i in range(n):
                x = f[cuts[i] : cuts[i + 1]]
                learner.update(x, float(ys[i]))
                if held + len(x) <= p.max_features:
                    kept.append((x.copy(), float(ys[i])))
                    held += len(x)
        for _ in range(p.epochs - 1):
            for x, y in kept:
                learner.update(x, y)
        return pickle.dumps(learner.model())

    return learn


def scorer(model: bytes):
    """Texts -> probability of label 1."""
    state: dict = {}

    def score(column: pa.Array) -> np.ndarray:
        if not state:
            m = pickle.loads(model)
            w = np.zeros(DIMENSIONS)
            w[m["at"]] = m["w"]
            state.update(w=w, bias=m["bias"])
        who, f, n = features(column)
        hit = np.flatnonzero(state["w"][f])  # few features have a weight; each counts once for a text
        key = np.unique(who[hit] * DIMENSIONS + f[hit])
        logit = state["bias"] + np.bincount(key >> BITS, weights=state["w"][key & (DIMENSIONS - 1)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))

    return score


def held_out(doc_id: Column) -> Column:
    return labelled.remainder(doc_id, 3) == 1


def fit(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> bytes:
    """A model from the labelled documents that are not held out; without any, every score is 0.5."""
    return labelled.train(labelled.training_rows(docs, labels, "toxic", held_out(F.col("doc_id")), p.max_rows), _learn(p))


def score_documents(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``.

    Only the text enters a score.  Null, empty and blank texts have no features and get the bias alone.  Equal texts get equal
    scores; repeated rows stay repeated; a null doc_id stays null and is not held out.  Labels that are null or belong to no document are not used.
    """
    out = labelled.score_rows(docs, scorer(fit(docs, labels, p)))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    return labelled.filter_rows(docs, scorer(fit(docs, labels, p)), lambda s: s < p.threshold)
