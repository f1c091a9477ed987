"""Quality by attention-based multiple-instance learning (operator 4).

A document is a bag of passages of ``PASSAGE_WORDS`` words.  Each passage is encoded from its bytes and
hashed word shapes; gated attention, learned from document labels alone, weighs the passages; the weighted
sum of their codes gives the score.  The model has a fixed size (some 10,000 numbers).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import labelled
from tidemark.llm.wordbuf import Texts, mix

PASSAGE_WORDS = 64
PRIOR_WORDS = 8  # added to a passage's length, so that a few words say little
WORD_SLOTS = 96
SHAPE_SLOTS = 64
# Classes of bytes: every ASCII mark by itself, then lower, upper, digit, blank, line break, other control, beyond ASCII.
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS = np.full(256, len(_MARKS) + 6, np.int64)
_CLASS[_MARKS] = np.arange(len(_MARKS))
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = len(_MARKS), len(_MARKS) + 1, len(_MARKS) + 2
_CLASS[:32], _CLASS[32], _CLASS[10] = len(_MARKS) + 5, len(_MARKS) + 3, len(_MARKS) + 4
BYTE_CLASSES = len(_MARKS) + 7
INPUTS = BYTE_CLASSES + SHAPE_SLOTS + WORD_SLOTS


@dataclass(frozen=True)
class Mil:
    """Learning parameters.  The sample is bounded by ``max_rows`` documents and ``max_passages`` passages; documents beyond are not learned from."""

    code: int = 24
    gate: int = 12
    epochs: int = 24
    batch: int = 64
    rate: float = 0.004
    decay: float = 1e-4
    max_rows: int = 8_000
    max_passages: int = 80_000
    threshold: float = 0.7
    seed: int = 5


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(inputs of every passage, first passage of each text + 1 end); a text without words has one passage of zeros."""
    t = Texts.of(column)
    start, end = t.spans
    count = np.maximum(1, -(-t.n_words // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    inside = np.arange(len(start)) - t.first_word[:-1][t.word_text]
    of_word = first[t.word_text] + inside // PASSAGE_WORDS
    # bytes belong to the passage of the last word begun before them
    mark = np.zeros(len(t.data), np.int64)
    mark[start] = 1
    begun = np.cumsum(mark) - 1
    at = np.flatnonzero(begun >= t.first_word[:-1].repeat(np.diff(t.bounds)))
    held = np.bincount(of_word[begun[at]] * BYTE_CLASSES + _CLASS[t.data[at]], minlength=total * BYTE_CLASSES).reshape(total, BYTE_CLASSES).astype(np.float32)
    held = np.sqrt(held / (held.sum(1, keepdims=True) + 6 * PRIOR_WORDS))
    head, tail = _CLASS[t.data[start]], _CLASS[t.data[end - 1]] if len(end) else _CLASS[:0]
    size = np.minimum(end - start, 12)
    shape = (mix((head * 4096 + tail * 16 + size).astype(np.uint64)) % np.uint64(SHAPE_SLOTS)).astype(np.int64)
    word = (t.words % np.uint64(WORD_SLOTS)).astype(np.int64)
    n = np.bincount(of_word, minlength=total)[:, None].astype(np.float32) + PRIOR_WORDS
    shapes = np.bincount(of_word * SHAPE_SLOTS + shape, minlength=total * SHAPE_SLOTS).reshape(total, SHAPE_SLOTS).astype(np.float32)
    slots = np.bincount(of_word * WORD_SLOTS + word, minlength=total * WORD_SLOTS).reshape(total, WORD_SLOTS).astype(np.float32)
    return np.concatenate([held, np.sqrt(shapes / n), np.sqrt(slots / n)], 1), first


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _start(p: Mil) -> dict[str, np.ndarray]:
    r = np.random.default_rng(p.seed)
    draw = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    return {"W": draw(INPUTS, p.code) * 3, "b": np.zeros(p.code, np.float32), "V": draw(p.code, p.gate), "U": draw(p.code, p.gate), "w": draw(p.gate, 1)[:, 0], "c": draw(p.code, 1)[:, 0], "d": np.zeros(1, np.float32)}


def forward(m: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> tuple:
    """Scores of bags (passages first[i] to first[i + 1]) and what the gradient needs."""
    heads, sizes = first[:-1], np.diff(first)
    h = np.tanh(x @ m["W"] + m["b"])
    tv, su = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (tv * su) @ m["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, heads), sizes))
    a = e / np.repeat(np.add.reduceat(e, heads), sizes)
    z = np.add.reduceat(a[:, None] * h, heads)
    return _sigmoid(z @ m["c"] + m["d"][0]), (heads, sizes, h, tv, su, a, z)


def _gradient(m, x, y, weight, out) -> dict[str, np.ndarray]:
    s, (heads, sizes, h, tv, su, a, z) = out
    g = ((s - y) * weight / len(y)).astype(np.float32)
    dz = np.repeat(g[:, None] * m["c"], sizes, 0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, heads), sizes))
    dt = de[:, None] * m["w"]
    dv, du = dt * su * (1 - tv**2), dt * tv * su * (1 - su)
    dh = (a[:, None] * dz + dv @ m["V"].T + du @ m["U"].T) * (1 - h**2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (tv * su).T @ de, "c": z.T @ g, "d": g.sum(keepdims=True)}


def _learn(p: Mil):
    def learn(stream: Iterator[tuple[pa.Array, np.ndarray]]) -> bytes:
        xs, sizes, ys, held = [], [], [], 0
        for column, y in stream:
            x, first = passages(column)
            fits = int(np.searchsorted(first, p.max_passages - held, side="right")) - 1
            xs.append(x[: first[fits]].astype(np.float16))
            sizes.append(np.diff(first)[:fits])
            ys.append(y[:fits])
            held += int(first[fits])
        m, state = _start(p), {}
        if held:
            x, size, y = np.concatenate(xs), np.concatenate(sizes), np.concatenate(ys).astype(np.float32)
            xs.clear()
            first = np.concatenate([[0], np.cumsum(size)])
            share = min(max(float(y.mean()), 0.02), 0.98)
            m["d"][0] = np.log(share / (1 - share)) if 0 < y.mean() < 1 else 8 * (y.mean() - 0.5)
            weight = np.where(y == 1, 1.0, min(0.5 / (1 - share), 1.5)).astype(np.float32)
            r, step = np.random.default_rng(p.seed), 0
            state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
            for epoch in range(p.epochs):
                order = r.permutation(len(y))
                rate = p.rate * (1 - 0.9 * epoch / p.epochs)
                for at in range(0, len(y), p.batch):
                    bag = order[at : at + p.batch]
                    rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in bag])
                    xb, fb = x[rows].astype(np.float32), np.concatenate([[0], np.cumsum(size[bag])])
                    grad, step = _gradient(m, xb, y[bag], weight[bag], forward(m, xb, fb)), step + 1
                    for k, g in grad.items():
                        g = g + p.decay * m[k]
                        u, v = state[k]
                        u += 0.1 * (g - u)
                        v += 0.001 * (g * g - v)
                        m[k] -= (rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return pickle.dumps(m)

    return learn


def scorer(model: bytes):
    """Texts -> probability of label 1."""
    state: dict = {}

    def score(column: pa.Array) -> np.ndarray:
        if not state:
            state.update(pickle.loads(model))
        return forward(state, *passages(column))[0]

    return score


def held_out(doc_id: Column) -> Column:
    return labelled.remainder(doc_id, 4) == 2


def fit(docs: DataFrame, labels: DataFrame, p: Mil = Mil()) -> bytes:
    """A model from the labelled documents that are not held out; without any, an untrained one."""
    return labelled.train(labelled.training_rows(docs, labels, "quality", held_out(F.col("doc_id")), p.max_rows), _learn(p))


def score_documents(docs: DataFrame, labels: DataFrame, p: Mil = Mil()) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``.

    Only the text enters a score; every passage of it does.  Null, empty and blank texts are one passage of zeros.  Equal texts get
    equal scores; repeated rows stay repeated; a null doc_id stays null and is not held out.  Labels that are null or belong to no document are not used.
    """
    out = labelled.score_rows(docs, scorer(fit(docs, labels, p)))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, p: Mil = Mil(), at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is not below ``at_least`` (lower than ``threshold``: in doubt a document stays)."""
    return labelled.filter_rows(docs, scorer(fit(docs, labels, p)), lambda s: s >= at_least)
