import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import packing as K


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def verify(rows, pieces, bpe, window=1024):
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*bpe.encode(t or "", add_special_tokens=False).ids, 0])
    docs, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        windows[p.sequence_id].append(p)
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    assert docs.keys() == want.keys()
    for i, copies in want.items():
        assert sum(p.length for p in docs[i]) == sum(map(len, copies))
        if len(copies) == 1:
            ids = []
            for p in sorted(docs[i], key=lambda p: p.start):
                assert p.start == len(ids) and p.doc_tokens == len(copies[0])
                ids += p.ids
            assert ids == copies[0]
    for ps in windows.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    used = [sum(p.length for p in ps) for ps in windows.values()]
    return sum(used), sum(u if u & (u - 1) == 0 else window for u in used)


def test_every_id_lies_in_one_piece_without_padding(documents, texts, bpe):
    tokens, held = verify(list(texts.items()), K.pack(documents).collect(), bpe)
    assert held == tokens


def test_edges(docs_of, edges, bpe, spark):
    verify(edges, K.pack(docs_of(edges)).collect(), bpe)
    assert K.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_of_odd_and_long_texts(bpe, texts):
    long = " ".join(texts.values())
    long = (long + " ") * (2 * K.LONG_TEXT // len(long) + 2)
    for t in [" a  b\n\n c\t", "it's  \n", "   ", "a<|endoftext|>b", "\r\n \r\n x", "   x  ", "x" * 5000, long]:
        assert list(K.token_ids(t, K.default_ranks())) == [*bpe.encode(t, add_special_tokens=False).ids, 0]


def test_choice_leaves_the_smallest_sum_of_squares():
    rng = np.random.default_rng(3)
    p = K.Packer(16)
    for _ in range(400):
        size = int(rng.integers(1, 16))
        options = {0: None} | {h: None for h in range(1, 17 - size) if p.levels[h] > 0}
        for h in options:
            n = p.levels.copy()
            n[h] -= h > 0
            n[h + size] += 1
            options[h] = int((n[1:16] ** 2).sum())
        got = p.choose(size)
        assert options[got] == min(options.values()) and got == max(h for h in options if options[h] == options[got])
        list(p.add(0, np.arange(size, dtype=np.uint32)))
        p.levels[16] = 0
