"""Words of many texts at once, as numpy arrays over the UTF-8 buffer of an Arrow column.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, i.e. ``[^\\x20\\x09-\\x0D]+``.  All
separators are ASCII, so cutting bytes equals cutting code points.  Hashes are 64 bits wide: random
values per byte under a polynomial in an odd base, then a finaliser, so that any span of the
buffer is hashed from two prefix sums.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; the table grows to the longest piece seen."""
    have = _powers.get(kind)
    if have is None or len(have) <= n:
        have = np.full(max(n, PIECE_BYTES) + 1, base, np.uint64)
        have[0] = 1
        _powers[kind] = have = np.cumprod(have, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) in runs of about ``limit`` bytes; a longer text is a run of its own."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(column):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, column.slice(at, to - at)
        at = to


@dataclass
class Texts:
    """Bytes of a run of texts and the boundaries between them."""

    data: np.ndarray
    bounds: np.ndarray  # of texts, n + 1

    @classmethod
    def of(cls, column: pa.Array, lower: bool = False) -> Texts:
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
        return cls(_LOWER[raw] if lower else raw, bounds - bounds[0])

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        return np.diff(self.running(flags)[self.bounds])

    @staticmethod
    def running(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=out[1:])
        return out

    @cached_property
    def separators(self) -> np.ndarray:
        return SEPARATOR[self.data]

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word; no word reaches across two texts."""
        inside = ~self.separators
        after = np.ones(len(inside), bool)
        after[1:] = self.separators[:-1]
        before = np.ones(len(inside), bool)
        before[:-1] = self.separators[1:]
        edge = self.bounds[(self.bounds > 0) & (self.bounds < len(inside))]
        after[edge] = True
        before[edge - 1] = True
        return np.flatnonzero(inside & after), np.flatnonzero(inside & before) + 1

    @cached_property
    def first_word(self) -> np.ndarray:
        """Index of each text's first word, n + 1 values."""
        return np.searchsorted(self.spans[0], self.bounds)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    @cached_property
    def word_text(self) -> np.ndarray:
        """Text number of every word."""
        return np.repeat(np.arange(self.n), self.n_words)

    @cached_property
    def _prefix(self) -> np.ndarray:
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_VALUES[self.data] * _power("up", _BASE, len(self.data))[: len(self.data)], out=out[1:])
        return out

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self._prefix
        return mix((h[end] - h[start]) * _power("down", _INVERSE, len(self.data))[start])

    @cached_property
    def words(self) -> np.ndarray:
        """Hash of every word."""
        return self.hash_spans(*self.spans)

    def shingles(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of k words inside one text; with ``short``, a text of fewer words gives its whole sequence as one."""
        w, count = self.words, self.n_words
        full = np.maximum(count - k + 1, 0)
        total = len(w)
        head = np.zeros(total, bool)
        if total:
            last = self.first_word[1:][self.word_text]  # end of the word's own text
            head = np.arange(total) + k <= last
        at = np.flatnonzero(head)
        h = np.zeros(len(at), np.uint64)
        for j in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + w[at + j]
        h = mix(h + np.uint64(k))
        if short:
            few = np.flatnonzero((full == 0) & (count > 0))
            if len(few):
                begin = self.first_word[:-1][few]
                g = np.zeros(len(few), np.uint64)
                for j in range(k - 1):
                    more = j < count[few]
                    g[more] = g[more] * np.uint64(0xD6E8FEB86659FD93) + w[begin[more] + j]
                at = np.concatenate([at, begin])
                h = np.concatenate([h, mix(g + count[few].astype(np.uint64))])
        return at, h
