"""SentencePiece encoding and decoding by streaming Viterbi (operator 8).

The encoder keeps scores of a window as long as the longest piece.  Ids are committed when the paths of all positions a further piece
could start from lead back to one boundary; what is held until then is two bytes a byte, at most of one word.
Blanks open pieces only, hence such a boundary lies before every word: texts are streamed word by word, each distinct
word of a run once, all words in step as numpy lanes; words beyond ``LANE_BYTES`` go through ``Stream`` character by character.

The score of a segmentation is the sum of the model's piece scores; of equal sums the longer last piece wins at each position.
Characters that are no piece become byte pieces, also a literal U+2581, so decoding returns every text exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.wordbuf import Texts, pieces

LANE_BYTES = 63
SLOT_BITS = 19
RUN_BYTES = 4 << 20
_models: dict[str, Model] = {}


class Model:
    """Pieces of a SentencePiece model as bytes, with a blank for U+2581, and hash tables of them and their beginnings."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        self.ids: dict[bytes, int] = {}
        self.score = np.zeros(n)
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([int(name[3:5], 16)])
                self.byte_id[self.bytes_of[i][0]] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = name.replace("▁", " ").encode()
                self.ids[self.bytes_of[i]] = i
                self.score[i] = sp.get_score(i)
        self.longest = max(map(len, self.ids))
        self.fallback = float(self.score.min()) - 10.0
        begin = sorted({p[:k] for p in self.ids for k in range(1, len(p) + 1)})
        data = np.frombuffer(b"".join(begin), np.uint8)
        ends = np.cumsum([len(b) for b in begin])
        t = Texts(data, np.array([0, len(data)]))
        keys = t.hash_spans(np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_piece = np.array([self.ids.get(b, -1) for b in begin])[order]
        slot = (self.keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slot = np.searchsorted(slot, np.arange(1 << SLOT_BITS)).astype(np.int32)  # first key of a slot
        self.slot[np.bincount(slot, minlength=1 << SLOT_BITS) == 0] = -1
        self.fullest = int(np.bincount(slot).max())
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.cuts = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``h`` that are beginnings of pieces, their keys' numbers)."""
        at = self.slot[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        full = np.flatnonzero(at >= 0)
        at, h = at[full].astype(np.int64), h[full]
        key = np.full(len(full), -1)
        for k in range(self.fullest):
            there = np.minimum(at + k, len(self.keys) - 1)
            key = np.where(self.keys[there] == h, there, key)
        hit = np.flatnonzero(key >= 0)
        return full[hit], key[hit]

    @classmethod
    def load(cls, path: str) -> Model:
        if path not in _models:
            _models[path] = cls(path)
        return _models[path]


class Stream:
    """Encodes bytes character by character; ``feed`` and ``end`` give ids as soon as they are certain.

    Scores are held for the last ``longest`` bytes only.  Of what is not committed yet the stream keeps the bytes and one byte per
    byte for the length of the best last piece there (2 bytes a byte, ``held``).  The paths of the window are stepped back together until they
    meet; where they do not, as on a run of one letter, the next look comes when twice as much is held, so time stays linear.
    """

    def __init__(self, model: Model):
        self.m, self.score = model, {0: 0.0}  # by place after the last committed boundary
        self.text, self.back = bytearray(), bytearray(b"\0")
        self.look = model.longest
        self.lengths = sorted({len(p) for p in model.ids}, reverse=True)

    @property
    def held(self) -> int:
        return len(self.text) + len(self.back)

    def feed(self, data: bytes) -> Iterator[int]:
        """``data``: whole characters."""
        m, k, score = self.m, 0, self.score
        while k < len(data):
            size = 1 if data[k] < 0x80 else 2 if data[k] < 0xE0 else 3 if data[k] < 0xF0 else 4
            self.text += data[k : k + size]
            self.back += bytes(size)
            k += size
            at = len(self.text)
            tail = bytes(self.text[-m.longest :])
            top, length = None, 0
            for n in self.lengths:
                if n <= at and (before := score.get(at - n)) is not None and (i := m.ids.get(tail[-n:])) is not None and (top is None or before + m.score[i] > top):
                    top, length = before + m.score[i], n
            if tail[-size:] not in m.ids and (before := score.get(at - size)) is not None and (top is None or before + m.fallback > top):
                top, length = before + m.fallback, size
            if length:
                score[at], self.back[at] = top, length
                for old in range(at - m.longest - size, at - m.longest):
                    score.pop(old, None)
                if at >= self.look:
                    yield from self._commit()
                    score = self.score

    def _commit(self) -> Iterator[int]:
        front = {p for p in self.score if p > len(self.text) - self.m.longest}
        while len(front) > 1:  # the furthest path steps back until all stand on one boundary
            last = max(front)
            front.remove(last)
            front.add(last - self.back[last])
        to = front.pop()
        if to:
            yield from self._emit(to)
        self.look = len(self.text) + self.m.longest if to else 2 * len(self.text)

    def _emit(self, to: int) -> Iterator[int]:
        path, p = [], to
        while p:
            path.append(p)
            p -= self.back[p]
        for p in reversed(path):
            piece = bytes(self.text[p - self.back[p] : p])
            i = self.m.ids.get(piece)
            if i is not None:
                yield i
            else:
                yield from (int(self.m.byte_id[b]) for b in piece)
        del self.text[:to], self.back[:to]
        self.back[0] = 0
        self.score = {p - to: v for p, v in self.score.items() if p >= to}

    def end(self) -> Iterator[int]:
        if self.text:
            yield from self._emit(len(self.text))


def _lanes(m: Model, t: Texts, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of short words, in step: (ids, first id of every word + 1 end)."""
    n = len(start)
    base = np.concatenate([[0], np.cumsum(size + 1)])  # position j of word w is base[w] + j
    lane = np.repeat(np.arange(n), size)
    off = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    lead = (t.data[start[lane] + off] & 0xC0) != 0x80
    lane, off = lane[lead], off[lead]
    first = t.data[start[lane] + off]
    width = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
    live = np.arange(len(lane))
    single = np.zeros(len(lane), bool)
    found = []
    for k in range(1, m.longest + 1):  # beginnings of pieces grow byte by byte; places without one drop out
        live = live[off[live] + k <= size[lane[live]]]
        s = start[lane[live]] + off[live]
        hit, at = m.find(t.hash_spans(s, s + k))
        live = live[hit]
        piece = m.key_piece[at]
        ok = piece >= 0
        found.append((live[ok], np.full(int(ok.sum()), k), piece[ok]))
        single[live[ok & (width[live] == k)]] = True
        if not len(live):
            break
    lack = np.flatnonzero(~single)
    found.append((lack, width[lack], np.full(len(lack), -1)))
    place, length, piece = (np.concatenate(x) for x in zip(*found))
    end = off[place] + length
    key = (end * 64 + (63 - length)).astype(np.uint16)  # both are below 64
    order = np.argsort(key, kind="stable")
    key, place, length, piece = key[order], place[order], length[order], piece[order]
    to, score = base[lane[place]] + end[order], np.where(piece >= 0, m.score[piece], m.fallback)
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    best = np.full(base[-1], -np.inf)
    best[base[:-1]] = 0.0
    back, by = np.zeros(base[-1], np.int64), np.full(base[-1], -1, np.int64)
    for a, b in zip(edges[:-1], edges[1:]):  # one end and one length at a time: every position is met once
        here = to[a:b]
        value = best[here - length[a]] + score[a:b]
        better = np.flatnonzero(value > best[here])
        here = here[better]
        best[here], back[here], by[here] = value[better], length[a], piece[a:b][better]
    at, who, out = base[:-1] + size, np.arange(n), []
    while len(who):
        out.append((who, at - base[who], by[at], back[at]))
        at = at - back[at]
        more = at > base[who]
        at, who = at[more], who[more]
    who, end, piece, length = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    order = np.lexsort((end, who))
    who, end, piece, length = who[order], end[order], piece[order], length[order]
    times = np.where(piece >= 0, 1, length)
    ids = np.repeat(piece, times)
    inner = np.arange(len(ids)) - np.repeat(np.cumsum(times) - times, times)
    raw = np.repeat(start[who] + end - length, times) + inner
    ids = np.where(ids >= 0, ids, m.byte_id[t.data[np.minimum(raw, len(t.data) - 1)]]) if len(ids) else ids
    return ids.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(who, weights=times, minlength=n).astype(np.int64))])


def _told_apart(t: Texts, start: np.ndarray, end: np.ndarray, pick: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words by hash, held to their bytes: words that differ from the first of their hash become words of their own."""
    size = end - start
    odd = size != size[pick][word]
    whole = np.flatnonzero(~odd & (pick[word] != np.arange(len(word))))
    for a in range(0, len(whole), 1 << 16):  # a few megabytes at a time
        rows = whole[a : a + (1 << 16)]
        n = size[rows]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = t.data[np.repeat(start[rows], n) + inner] != t.data[np.repeat(start[pick[word[rows]]], n) + inner]
        odd[rows] = np.add.reduceat(differ, np.cumsum(n) - n) > 0 if len(n) else False
    rows = np.flatnonzero(odd)
    if len(rows):
        word = word.copy()
        word[rows] = len(pick) + np.arange(len(rows))
        pick = np.concatenate([pick, rows])
    return pick, word


def encode_run(m: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a run of texts and the first id of each text + 1 end.  A text is read with a blank before it; an empty one has no ids."""
    column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
    t = Texts.of(column)
    blank = t.data == 32
    opens = blank.copy()
    opens[1:] &= ~blank[:-1]
    opens[t.bounds[:-1][np.diff(t.bounds) > 0]] = True
    start = np.flatnonzero(opens)
    end = np.concatenate([start[1:], [len(t.data)]]) if len(start) else start
    h = t.hash_spans(start, end)
    _, pick, word = np.unique(h, return_index=True, return_inverse=True)
    pick, word = _told_apart(t, start, end, pick, word)
    s, e = start[pick], end[pick]
    short = e - s <= LANE_BYTES
    ids, cut = _lanes(m, t, s[short], (e - s)[short])
    size = np.zeros(len(pick), np.int64)
    size[short] = np.diff(cut)
    where = np.zeros(len(pick), np.int64)
    where[short] = cut[:-1]
    extra, total = [], len(ids)
    for k in np.flatnonzero(~short):
        stream = Stream(m)
        got = np.array([*stream.feed(t.data[s[k] : e[k]].tobytes()), *stream.end()], np.int32)
        where[k], size[k] = total, len(got)
        extra.append(got)
        total += len(got)
    ids = np.concatenate([ids, *extra])
    times = size[word]
    out = np.repeat(where[word] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    edge = np.concatenate([[0], np.cumsum(times)])
    return ids[out], edge[np.searchsorted(start, t.bounds)]


def decode_run(m: Model, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Texts of a run of id sequences, without the blank before each."""
    size = np.diff(m.cuts)[ids]
    at = np.repeat(m.cuts[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    edge = np.concatenate([[0], np.cumsum(size)])[cuts]
    stay = np.ones(len(at), bool)
    stay[edge[:-1][np.diff(edge) > 0]] = False
    bounds = np.concatenate([[0], np.cumsum(stay)])[edge]
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(m.flat[at][stay].tobytes()))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs(doc_id, text)``; null and empty texts have no ids.

    Texts of any length are read whole.  Repeated rows and null ids stay; other columns are not read.
    """
    path = model_file or default_model()

    def run(batches):
        m = Model.load(path)
        for b in batches:
            for first, column in pieces(b.column("text"), RUN_BYTES):
                ids, cuts = encode_run(m, column)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(column)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model_file: str | None = None) -> DataFrame:
    """``(doc_id, text)`` for every row of ``coded(doc_id, ids)``; null or no ids give the empty text.  Control and unknown ids give nothing."""
    path = model_file or default_model()

    def run(batches):
        m = Model.load(path)
        for b in batches:
            lists = pc.fill_null(b.column("ids"), pa.scalar([], pa.list_(pa.int32())))
            cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), decode_run(m, pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64), cuts).cast(pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """``(doc_id, n_ids, ids_crc32, text_crc32, decoded_crc32, exact)``: every text encoded and decoded again in one pass."""
    path = model_file or default_model()

    def run(batches):
        m = Model.load(path)
        for b in batches:
            for first, column in pieces(b.column("text"), RUN_BYTES):
                ids, cuts = encode_run(m, column)
                back = decode_run(m, ids, cuts)
                raw = ids.astype("<u4")
                cast = column.cast(pa.large_binary())
                crc = lambda a: pa.array((zlib.crc32(x.as_buffer()) for x in a), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, len(column)), pa.array(np.diff(cuts)), pa.array((zlib.crc32(raw[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:])), pa.int64()), crc(cast), crc(back.cast(pa.large_binary())), pc.equal(column, back)],
                    ["doc_id", "n_ids", "ids_crc32", "text_crc32", "decoded_crc32", "exact"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, decoded_crc32 long, exact boolean")
