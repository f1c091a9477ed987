"""Line-first cleaning (operator 10).

Every line is judged by itself: punctuation (a finished sentence, few symbols, no shouting), navigation
(separator marks between short entries) and boilerplate (stock phrases of web pages).  Failing lines are
removed; a document that loses too much of its text is rejected.

Work per text is done on numpy arrays over the Arrow buffer, inside ``mapInArrow``: no shuffle, no group.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.wordbuf import Texts, mix, pieces

# Stock phrases of web pages, lower case.
BOILERPLATE = [
    "accept all cookies", "all rights reserved", "click here to", "enable javascript", "javascript is disabled", "log in to comment", "lorem ipsum",
    "privacy policy", "read more at", "share this article", "sign up for our newsletter", "skip to content", "subscribe to our", "terms of service",
    "terms of use", "use of cookies", "we use cookies",
]
NAVIGATION_MARKS = ("|", "»", "›", "•", "·", "→")
CLOSERS = "\"')]}*_”’»"
ENDINGS = ".!?:;…。！？"


@dataclass(frozen=True)
class Rules:
    """Thresholds.  Shares are of the line's or the document's word characters."""

    max_symbol_share: float = 0.10  # of a line
    max_upper_share: float = 0.60  # of a line with at least shouting_words words
    shouting_words: int = 3
    mark_every: int = 4  # a navigation line has a mark in at least every so many words
    min_marks: int = 2
    max_unfinished_words: int = 3  # a line without closing punctuation fails up to so many words
    max_lost_share: float = 0.40  # of the document


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _flag(b"#*$%&|<>")
_UPPER = _flag(bytes(range(65, 91)))
_LOWERED = _flag(bytes(range(97, 123)))
_STOCK = re.compile(b"|".join(re.escape(x.encode()) for x in BOILERPLATE))
_END_TAIL = [c.encode() for c in ENDINGS]
_CLOSE_TAIL = [c.encode() for c in CLOSERS]

def _tail_is(data: np.ndarray, start: np.ndarray, end: np.ndarray, tails: list[bytes]) -> np.ndarray:
    """Length of the tail that the span ends with, 0 if none; tails have up to three bytes."""
    got = np.zeros(len(end), np.int64)
    if not len(data):
        return got
    for t in tails:
        fits = end - start >= len(t)
        for k, b in enumerate(t):
            fits &= data[np.maximum(end - len(t) + k, 0)] == b
        got[fits] = len(t)
    return got


def judge(column: pa.Array, rules: Rules) -> dict[str, np.ndarray | pa.Array]:
    """Counts, line verdicts and the cleaned texts of a run of texts."""
    t = Texts.of(column)
    data, n = t.data, t.n
    start, end = t.spans
    point = (data & 0xC0) != 0x80
    in_word = point & ~t.separators
    run_chars = t.running(in_word)
    n_words = t.n_words

    # words that lie in an eight-word window found twice in the text
    at, h = t.shingles(8)
    key = mix(h + t.word_text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) if len(at) else h
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 8, -1)
    covered = np.cumsum(cover)[:-1] > 0
    n_repeat = np.bincount(t.word_text[covered], minlength=n)

    # lines: cut at \n, one at least for each text
    breaks = np.flatnonzero(data == 10)
    begins = np.concatenate([t.bounds[:-1], breaks + 1])
    ends = np.concatenate([breaks, t.bounds[1:]])
    owner = np.concatenate([np.arange(n), np.searchsorted(t.bounds, breaks, side="right") - 1])
    by = np.lexsort((begins, owner))
    begins, owner = begins[by], owner[by]
    owner_end = np.concatenate([np.searchsorted(t.bounds, breaks, side="right") - 1, np.arange(n)])
    ends = ends[np.lexsort((ends, owner_end))]
    w0, w1 = np.searchsorted(start, begins), np.searchsorted(start, ends)
    words = w1 - w0
    full = words > 0
    lk = mix(t.hash_spans(begins[full], ends[full]) + owner[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(lk, return_index=True)
    n_dup = np.bincount(owner[full], minlength=n) - np.bincount(owner[full][first], minlength=n)

    # rules of a line
    symbol, upper, lower = (t.running(f[data]) for f in (_SYMBOL, _UPPER, _LOWERED))
    over = lambda r: r[ends] - r[begins]
    chars = over(run_chars)
    head, tail = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
    if len(start):
        head[full], tail[full] = start[w0[full]], end[w1[full] - 1]
    cut = tail.copy()
    for _ in range(3):  # up to three closing quotes, brackets or emphasis marks after the sentence's end
        cut -= np.where(full, _tail_is(data, head, cut, _CLOSE_TAIL), 0)
    unfinished = full & (_tail_is(data, head, cut, _END_TAIL) == 0) if len(data) else full
    marks = np.zeros(len(begins), np.int64)
    if len(start):
        mark_word = np.zeros(len(start) + 1, np.int64)
        for m in NAVIGATION_MARKS:
            b = m.encode()
            is_mark = end - start == len(b)
            for k, x in enumerate(b):
                is_mark &= data[np.minimum(start + k, len(data) - 1)] == x
            mark_word[1:] += is_mark
        marks = np.cumsum(mark_word)[w1] - np.cumsum(mark_word)[w0]
    stock = np.zeros(len(begins), bool)
    for m in _STOCK.finditer(data.tobytes().lower()):
        a = np.searchsorted(begins, m.start(), side="right") - 1
        if m.end() <= ends[a]:
            stock[a] = True
    letters = over(upper) + over(lower)
    failed = full & (
        (unfinished & (words <= rules.max_unfinished_words))
        | (over(symbol) > rules.max_symbol_share * chars)
        | ((words >= rules.shouting_words) & (over(upper) > rules.max_upper_share * np.maximum(letters, 1)))
        | ((marks >= rules.min_marks) & (marks * rules.mark_every >= words))
        | stock
    )
    lost = np.bincount(owner, weights=np.where(failed, chars, 0), minlength=n).astype(np.int64)
    word_chars = t.per_text(in_word)
    base_failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
    kept = ~base_failed & (lost <= rules.max_lost_share * word_chars)

    drop = np.zeros(len(data) + 1, np.int8)  # bytes of failed lines with their line break
    np.add.at(drop, begins[failed], 1)
    np.add.at(drop, np.minimum(ends[failed] + 1, t.bounds[1:][owner[failed]]), -1)
    stay = np.cumsum(drop[:-1]) == 0
    bounds = t.running(stay)[t.bounds]
    cleaned = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[stay].tobytes()))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": t.per_text(_SYMBOL[data]), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "n_lines": np.bincount(owner[full], minlength=n), "n_failed_lines": np.bincount(owner[failed], minlength=n), "lost_chars": lost,
        "base_failed": base_failed, "kept": kept, "cleaned": pc.utf8_rtrim(cleaned, "\n"),
    }


def clean_lines(docs: DataFrame, rules: Rules = Rules(), cleaned: bool = True) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts, verdict and (with ``cleaned``) the text without failed lines.

    Null or empty text: no words, ``base_failed``, not kept, cleaned "".  A text of blanks likewise.  Repeated
    rows are judged each by itself; a null doc_id stays null.  Other columns of ``docs`` are not read.
    ``n_symbols`` counts the eight characters # * $ % & | < >.
    """
    fields = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "lost_chars", "base_failed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column in pieces(batch.column("text")):
                out = judge(column, rules) | {"doc_id": batch.column("doc_id").slice(first, len(column))}
                names = [*fields, *["cleaned"] * cleaned]
                kinds = {"doc_id": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "cleaned": pa.string()}
                yield pa.RecordBatch.from_arrays([(out[k] if isinstance(out[k], pa.Array) else pa.array(out[k])).cast(kinds.get(k, pa.int64())) for k in names], names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_failed_lines long, lost_chars long, base_failed boolean, kept boolean" + ", cleaned string" * cleaned
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
