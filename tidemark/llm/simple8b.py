"""Token ids in word-aligned binary files (operator 13).

Simple-8b: a 64-bit word holds a selector in its top four bits and up to 60 values of equal width below.  Selector s of
``COUNTS`` packs COUNTS[s] values of BITS[s] bits; values of more than 60 bits are escapes, kept beside the words with
their positions, and a zero stands in their place.  Values are cut into blocks of at most ``BLOCK`` of one document; words of a
block never hold values of the next one, so any block is decoded from its offset alone, and all words of one selector
are unpacked together as one array.

A file is a run of frames, each of whole documents and about ``FRAME_IDS`` ids, written in ascending doc_id order.  All of
a frame is little-endian 64-bit words:

    magic, words of the frame, slot, number in the slot, documents, blocks, ids, code words, escapes, ids before it in the slot, crc32 of all that follows
    doc_id per document · 1 where it is null · blocks up to the end of each document
    ids up to the end of each block · code words up to the end of each block
    positions of escapes · their values · code words

and the 8-byte mark ``END`` closes it.  A slot is a range of doc_ids; ``index`` beside the files holds how many ids lie before each slot.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import checkpoint_dir, cut_lineage

# Selectors: values in a word and their width.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
FRAME_IDS = 1 << 18
FRAMES_PER_FILE = 64
END_ID = 1
MAGIC = np.frombuffer(b"TMIDS8B1", "<u8")[0]
END = "TMIDSEND"
HEADER = 11
_ESCAPE = np.uint64(1 << 60)
_LIMITS = np.uint64(1) << BITS.astype(np.uint64)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def encode(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, words up to the end of each block, positions of escapes) of non-empty blocks that end at ``ends``."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64), np.zeros(0, np.int64)
    values = values.astype(np.uint64)
    escapes = np.flatnonzero(values >= _ESCAPE)
    if len(escapes):
        values[escapes] = 0
    narrowest = _SMALL[np.minimum(values, len(_SMALL) - 1)]
    large = np.flatnonzero(values >= len(_SMALL))
    if len(large):
        narrowest[large] = np.searchsorted(_LIMITS, values[large], side="right")
    begins = np.append(0, ends[:-1])
    widest = int(narrowest.max())
    choice = np.full(n, widest, np.uint8)
    for s in range(widest - 1, -1, -1):  # a narrower selector takes more values, so it overrides
        fits = narrowest <= s
        if not fits.any():
            break
        every = _windows(fits, int(COUNTS[s]))
        tail = np.ones(len(ends), bool)
        for back in range(1, int(COUNTS[s])):  # the last values of a block may fill a word by themselves
            at = ends - back
            tail &= at >= begins
            if not tail.any():
                break
            tail[tail] = fits[at[tail]]
            short = at >= begins
            every[at[short]] = tail[short]
        choice[every] = s
    starts = _walk(choice, ends)
    chosen, block_end = choice[starts], np.repeat(ends, np.diff(np.searchsorted(starts, ends), prepend=0))
    words = chosen.astype(np.uint64) << np.uint64(60)
    values = np.append(values, np.zeros(int(COUNTS[0]), np.uint64))
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        at, packed = starts[rows], np.zeros(len(rows), np.uint64)
        part = np.flatnonzero(at + COUNTS[s] > block_end[rows])
        for j in range(COUNTS[s]):
            value = values[at + j]
            if len(part):
                value[part[at[part] + j >= block_end[rows[part]]]] = 0
            packed |= value << np.uint64(j * BITS[s])
        words[rows] |= packed
    return words, np.searchsorted(starts, ends), escapes


def _windows(fits: np.ndarray, count: int) -> np.ndarray:
    """Whether a value and the ``count - 1`` after it all fit; false where fewer follow."""
    out, have = fits.copy(), 1
    while have < count:
        step = min(have, count - have)
        out[:-step] &= out[step:]
        out[len(out) - step :] = False
        have += step
    return out


def _walk(choice: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first value of every word: all blocks go from word to word in step."""
    step, at, stop, starts = COUNTS[choice], np.append(0, ends[:-1]), ends, []
    while len(at):
        starts.append(at)
        at = at + step[at]
        more = at < stop
        at, stop = at[more], stop[more]
    return np.sort(np.concatenate(starts))


def decode(words: np.ndarray, word_ends: np.ndarray, ends: np.ndarray, escapes: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The values of all blocks, from their words and the ends of their values."""
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    taken = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    block = np.repeat(np.arange(len(ends)), np.diff(word_ends, prepend=0))
    first_word = np.append(0, word_ends[:-1])[block]
    at = np.append(0, ends[:-1])[block] + taken - taken[first_word]
    stop = ends[block]
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        w, mask = words[rows], np.uint64((1 << int(BITS[s])) - 1)
        for j in range(COUNTS[s]):
            inside = at[rows] + j < stop[rows]
            out[at[rows][inside] + j] = (w[inside] >> np.uint64(j * BITS[s])) & mask
    out[escapes] = escaped
    return out


def block_ends(lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(ends of blocks, blocks up to the end of each document) for documents of the given positive lengths."""
    blocks = -(-lengths // block)
    upto = np.cumsum(blocks)
    doc = np.repeat(np.arange(len(lengths)), blocks)
    inside = np.arange(len(doc)) - (upto - blocks)[doc] + 1
    return (np.cumsum(lengths) - lengths)[doc] + np.minimum(inside * block, lengths[doc]), upto


class WordIds:
    """Ids of a text by the tokenizers library, word by word: the tokenizer cuts at white space and drops it, so words are independent.

    Known words are kept in two generations of bounded size.  ASCII capitals are lowered beforehand, as the tokenizer does so
    itself, unless the text holds a special token's mark or combining accents.  A word of small Latin letters goes to the library's
    model at once; a comma or full stop at its end is a token of its own.
    """

    _LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

    class _Known(dict):
        def __init__(self, encode, limit):
            self.encode, self.limit, self.older = encode, limit, {}

        def __missing__(self, word):
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            ids = self.older.get(word)
            if ids is None:
                ids = self.encode(word)
            if len(word) <= 48:
                self[word] = ids
            return ids

    def __init__(self, file: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.by_words = _cuts_at_white_space(self.tokenizer)
        self.known = self._Known(self._encode, limit)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.symbols = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}  # a byte's symbol in byte-level vocabularies
        self.symbols = [self.symbols[b] for b in range(256)]

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, word: bytes) -> bytes:
        letters = self._LETTERS.match(word)
        if letters and letters.end() == len(word):
            text = word.decode() if word.isascii() else "".join([self.symbols[b] for b in word])
            return self._packed([t.id for t in self.model.tokenize(text)])
        if letters and letters.end() == len(word) - 1 and word[-1] in b",.;:!?":
            return self.known[word[:-1]] + self.known[word[-1:]]
        return self._packed(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def __call__(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
        return b"".join(map(self.known.__getitem__, text.split()))


def _cuts_at_white_space(tokenizer) -> bool:
    """Whether the file is of the kind whose words can be encoded one by one, lower-cased."""
    import json

    j = json.loads(tokenizer.to_str())
    steps = [x["type"] for x in (j["normalizer"] or {}).get("normalizers", [])]
    cut = ((j["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    plain = cut.get("pattern", {}).get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and cut.get("invert") is True
    return steps == ["NFC", "Replace", "Lowercase"] and plain and all(not (t["lstrip"] or t["rstrip"]) for t in j["added_tokens"])


_word_ids: dict[str, WordIds] = {}


def word_ids(file: str) -> WordIds:
    """One encoder per worker process."""
    if file not in _word_ids:
        _word_ids[file] = WordIds(file)
    return _word_ids[file]


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def coded(file: str, bounds: list[int], end_id: int):
    """Arrow batches of (doc_id, tie, text) to (doc_id, tie, slot, n_ids, code): each document's blocks and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, edges, last = word_ids(file), np.array(bounds, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            at = 0
            texts = batch.column("text").cast(pa.large_binary())
            while at < len(batch):
                parts, held, to = [], 0, at
                while to < len(batch) and held < 4 * FRAME_IDS:
                    parts.append(ids_of(texts[to].as_py() or b"") + last)
                    held += len(parts[-1])
                    to += 1
                yield _coded_rows(batch.slice(at, to - at), parts, edges)
                at = to

    return run


def _coded_rows(batch: pa.RecordBatch, parts: list[bytes], edges: np.ndarray) -> pa.RecordBatch:
    lengths = np.array([len(p) // 4 for p in parts], np.int64)
    ids = np.frombuffer(b"".join(parts), "<u4")
    ends, upto = block_ends(lengths)
    words, word_ends, escapes = encode(ids, ends)
    first = np.cumsum(lengths) - lengths
    code = []
    for d, (b0, b1) in enumerate(zip(np.append(0, upto[:-1]), upto)):
        w0, w1 = word_ends[b0 - 1] if b0 else 0, word_ends[b1 - 1]
        e = escapes[(escapes >= first[d]) & (escapes < first[d] + lengths[d])] if len(escapes) else escapes
        code.append(np.concatenate([[b1 - b0, len(e)], ends[b0:b1] - first[d], word_ends[b0:b1] - w0, e - first[d], ids[e], words[w0:w1]]).astype("<u8", copy=False).tobytes() if len(e) else
                    np.array([b1 - b0, 0, *(ends[b0:b1] - first[d]), *(word_ends[b0:b1] - w0)], "<u8").tobytes() + words[w0:w1].astype("<u8", copy=False).tobytes())
    key = batch.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(edges, key, side="left"), np.searchsorted(edges, key, side="right")
    share = (batch.column("tie").to_numpy(zero_copy_only=False).astype(np.float64) + 2.0**63) / 2.0**64
    slot = np.minimum(low + ((high - low + 1) * share).astype(np.int64), high).astype(np.int32)  # rows of one frequent id spread over the slots it fills
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(slot), pa.array(lengths), pa.array(code, pa.binary())], ["doc_id", "tie", "slot", "n_ids", "code"])


def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Coded documents of whole slots in order to frames; only the frame at hand is held."""
    held: list[tuple] = []
    slot, number, before, size = None, 0, 0, 0
    for batch in batches:
        for doc, s, n, code in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "slot", "n_ids", "code"))):
            if held and (s != slot or size >= FRAME_IDS):
                yield pa.RecordBatch.from_arrays([pa.array([_frame(held, slot, number, before)], pa.binary())], ["frame"])
                number, before, held, size = number + 1, before + size, [], 0
            if s != slot:
                slot, number, before = s, 0, 0
            held.append((doc, n, np.frombuffer(code, "<u8")))
            size += n
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([_frame(held, slot, number, before)], pa.binary())], ["frame"])


def _frame(held: list[tuple], slot: int, number: int, before: int) -> bytes:
    blocks = [int(c[0]) for _, _, c in held]
    escapes = [int(c[1]) for _, _, c in held]
    ids_before = np.cumsum([0, *(n for _, n, _ in held)])
    ends, word_ends, at, values, words, n_words = [], [], [], [], [], 0
    for (_, _, c), b, e, base in zip(held, blocks, escapes, ids_before):
        ends.append(c[2 : 2 + b] + np.uint64(base))
        word_ends.append(c[2 + b : 2 + 2 * b] + np.uint64(n_words))
        if e:
            at.append(c[2 + 2 * b : 2 + 2 * b + e] + np.uint64(base))
            values.append(c[2 + 2 * b + e : 2 + 2 * b + 2 * e])
        words.append(c[2 + 2 * b + 2 * e :])
        n_words += len(words[-1])
    docs = [np.array([d or 0 for d, _, _ in held], "<i8").view("<u8"), np.array([d is None for d, _, _ in held], "<u8"), np.cumsum(blocks).astype("<u8")]
    body = np.concatenate([*docs, *ends, *word_ends, *at, *values, *words])
    head = [HEADER + len(body), slot, number, len(held), sum(blocks), int(ids_before[-1]), n_words, sum(escapes), before, zlib.crc32(body.tobytes())]
    return np.array([MAGIC, *head], "<u8").tobytes() + body.tobytes()


def read_frames(content: bytes) -> Iterator[dict]:
    """The frames of one file, decoded; damaged or cut files are an error."""
    at = 0
    while at < len(content):
        head = np.frombuffer(content, "<u8", HEADER, at) if len(content) - at >= 8 * HEADER else np.zeros(HEADER, "<u8")
        if head[0] != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        size, slot, number, docs, blocks, n_ids, n_words, escapes, before, crc = (int(x) for x in head[1:])
        stop = at + 8 * size
        if content[stop : stop + len(END)] != END.encode() or zlib.crc32(content[at + 8 * HEADER : stop]) != crc:
            raise ValueError(f"damaged frame at byte {at}")
        body = np.frombuffer(content, "<u8", size - HEADER, at + 8 * HEADER)
        doc, null, upto, ends, word_ends, where, escaped, words = np.split(body, np.cumsum([docs, docs, docs, blocks, blocks, escapes, escapes]))
        ends, upto = ends.astype(np.int64), upto.astype(np.int64)
        ids = decode(words, word_ends.astype(np.int64), ends, where.astype(np.int64), escaped)
        assert len(ids) == n_ids and len(words) == n_words
        yield {"slot": slot, "number": number, "before": before, "doc_id": doc.view("<i8"), "null": null.astype(bool), "ends": ends[upto - 1], "ids": ids}
        at = stop + len(END)


def write_ids(docs: DataFrame, path: str, file: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of ``docs(doc_id, text)`` under ``path``: ``ids/`` with the files, ``index/`` with the ids before each slot.

    Each document's ids are those of the tokenizer file without added special tokens, then ``end_id``; null and empty texts give
    ``end_id`` alone.  Files are in ascending doc_id order, null ids first; rows of one id are all written, in any order.  Other
    columns are not read; no rows give no files.  Texts are encoded where they lie, and coded words go to their slot (a range of doc_ids from
    approximate quantiles, as many as shuffle partitions) in one shuffle.
    """
    spark = docs.sparkSession
    file = file or default_file()
    key = F.col("doc_id").cast("long")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cut = docs.agg(F.percentile_approx(F.coalesce(key, F.lit(np.iinfo(np.int64).min).cast("long")), [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    rows = docs.select(key.alias("doc_id"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(coded(file, [int(x) for x in cut], end_id), "doc_id long, tie long, slot int, n_ids long, code binary")
    rows = rows.repartitionById(len(cut) + 1, F.col("slot")).sortWithinPartitions("slot", F.col("doc_id").asc_nulls_first(), "tie")
    out = rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    out.write.option("lineSep", END).option("maxRecordsPerFile", FRAMES_PER_FILE).text(f"{path}/ids")


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """What the files under ``path`` hold, one row per document: doc_id, slot, in_slot (ids before it in its slot), n_tokens, ids_crc32, with ``with_ids`` ids."""
    kinds = {"doc_id": pa.int64(), "slot": pa.int32(), "in_slot": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int64())} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for f in read_frames(content.as_py()):
                    ends = f["ends"]
                    starts = np.append(0, ends[:-1])
                    raw = memoryview(f["ids"].astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                    columns = [pa.array(f["doc_id"], mask=f["null"]), pa.array(np.full(len(ends), f["slot"], np.int32)), pa.array(f["before"] + starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]).astype(np.int32)), pa.array(f["ids"].astype(np.int64))))
                    yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds.values())], list(kinds))

    schema = "doc_id long, slot int, in_slot long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spark.read.format("binaryFile").load(f"{path}/ids").select("content").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, file: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents and return what the files give back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it in ascending doc_id order (null ids first, rows of one id in the order
    of the files).  Without ``path`` the files go to the shared folder.  Edge cases are as in ``write_ids``.
    """
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/ids_{uuid.uuid4().hex}"
    write_ids(docs, path, file, end_id)
    found = cut_lineage(read_ids(spark, path, with_ids=False))
    sizes = found.groupBy("slot").agg(F.sum("n_tokens").alias("n"))  # one row a slot
    before = F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.select("slot", before.alias("before")).write.parquet(f"{path}/index")
    return found.join(spark.read.parquet(f"{path}/index"), "slot").select("doc_id", (F.col("before") + F.col("in_slot")).alias("start"), "n_tokens", "ids_crc32")
