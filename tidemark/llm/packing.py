"""Sum-of-squares online packing (operator 5).

Documents arrive one after another.  ``levels[h]`` counts the open windows filled to h tokens; a
document goes to the level (or a new window) that leaves the sum of squared counts smallest.  Each Spark
partition packs its own documents, so nothing is shuffled and memory holds only open windows.  When a partition ends,
its open windows are completed by cutting the emptiest ones into the gaps of the fullest; what is then
left, less than one window, becomes windows of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END_ID = 0
LONG_TEXT = 1 << 20
#: Between a non-blank and one blank before a letter the pre-tokeniser always cuts.
_SAFE_CUT = re.compile(r"(?<=\S) (?=[A-Za-z])")
#: The published split pattern with possessive quantifiers: the same cuts, without backtracking.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_encoders: dict = {}


def encoder(ranks_file: str):
    """A byte-level BPE from a file of ranks; ``<|endoftext|>`` is the id after the last rank."""
    if ranks_file not in _encoders:
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[ranks_file] = tiktoken.Encoding("byte_bpe", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _encoders[ranks_file]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_ids(text: str | None, ranks_file: str) -> np.ndarray:
    """Ids of a whole text and the end id; texts over a megabyte go through in safe cuts."""
    text, bpe, out, at = text or "", encoder(ranks_file), [], 0
    while at < len(text):
        to = len(text)
        if to - at > LONG_TEXT and (m := _SAFE_CUT.search(text, at + LONG_TEXT)):
            to = m.start()
        out.append(bpe.encode_to_numpy(text[at:to], allowed_special="all"))
        at = to
    return np.concatenate([*out, np.array([END_ID], np.uint32)])


class Packer:
    """The open windows of one partition.  A piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def choose(self, size: int) -> int:
        """The fill level (0: a new window) whose use leaves the smallest sum of squares; the fullest of equals."""
        n, top = self.levels, self.window - size
        cost = 2 * (n[size : self.window + 1] - n[: top + 1]) + 2
        cost[0] = 2 * n[size] + 1
        cost[top] = 1 - 2 * n[top]
        cost[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        """Place a document; yields the windows that are full."""
        total, start = len(ids), 0
        while total - start >= self.window:
            yield [(doc, start, ids[start : start + self.window], total)]
            start += self.window
        if start == total:
            return
        size = total - start
        level = self.choose(size)
        pieces = self.open[level].pop() if level else []
        self.levels[level] -= level > 0
        pieces.append((doc, start, ids[start:], total))
        if level + size == self.window:
            yield pieces
        else:
            self.open.setdefault(level + size, []).append(pieces)
            self.levels[level + size] += 1

    def close(self) -> Iterator[list]:
        """Complete the fullest windows from the emptiest; the last remainder goes into power-of-two windows."""
        rest = deque((level, pieces) for level in sorted(self.open, reverse=True) for pieces in self.open[level])
        self.open, self.levels = {}, np.zeros_like(self.levels)
        while rest:
            level, pieces = rest.popleft()
            while level < self.window and rest:
                other, source = rest.pop()
                while source and level < self.window:
                    doc, start, ids, total = source.pop()
                    take = min(len(ids), self.window - level)
                    pieces.append((doc, start, ids[:take], total))
                    level, other = level + take, other - take
                    if take < len(ids):
                        source.append((doc, start + take, ids[take:], total))
                if source:
                    rest.append((other, source))
            if level == self.window:
                yield pieces
                continue
            queue = deque(pieces)
            for bit in reversed(range(level.bit_length())):
                if level >> bit & 1:
                    size, part = 1 << bit, []
                    while size:
                        doc, start, ids, total = queue.popleft()
                        take = min(len(ids), size)
                        part.append((doc, start, ids[:take], total))
                        size -= take
                        if take < len(ids):
                            queue.appendleft((doc, start + take, ids[take:], total))
                    yield part


def pack(docs: DataFrame, window: int = WINDOW, ranks_file: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece of ``docs(doc_id, text)``: where its ids lie in which sequence.

    Ids equal those of the byte-level BPE of 50,257 entries without added special tokens, then id 0.
    Every id lies in exactly one piece, also of null or empty texts (one piece with id 0 alone), of
    texts of any length and of repeated rows (each is packed; a null doc_id stays null).  No rows give no rows.
    Other columns are not read.  ``sequence_id`` is unique over all partitions, not gapless.
    """
    ranks_file = ranks_file or default_ranks()
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
    if with_ids:
        kinds["ids"] = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base, count, rows = Packer(window), TaskContext.get().partitionId() << 32, 0, []

        def windows():
            for batch in batches:
                for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                    yield from packer.add(doc.as_py(), token_ids(text.as_py(), ranks_file))
            yield from packer.close()

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], list(kinds))

        for pieces in windows():
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + count, offset, *([ids.astype(np.int32)] if with_ids else [])))
                offset += len(ids)
            count += 1
            if len(rows) >= 2048:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
