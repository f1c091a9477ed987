import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import sharding as S


def verify(rows, got, shards):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, held = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert set(slots) <= set(range(shards))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return held


def test_shards_hold_near_equal_bytes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = verify([(r.doc_id, r.text) for r in docs.collect()], S.kd_shards(docs, 16).collect(), 16)
    mean = sum(held.values()) / 16
    largest = max(len((r.text or "").encode()) + 1 for r in docs.collect())
    assert len(held) == 16 and max(abs(b - mean) for b in held.values()) <= largest  # a split is off by a part of one document at most


def test_leaves_equal_plain_recursion(spark):
    """Rows sorted by the widest dimension, then by id, cut where the first half of the shards has its share."""
    rng = np.random.default_rng(4)
    rows = [(i, "x" * int(n), f"l{int(a)}", f"s{int(b)}") for i, (n, a, b) in enumerate(zip(rng.integers(0, 60, 400), rng.integers(0, 4, 400), rng.integers(0, 30, 400)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.shard for r in S.kd_shards(docs, 8, {"a": F.crc32("lang"), "b": F.crc32("source")}).collect()}
    crc = lambda s: zlib.crc32(s.encode())
    span = [max(x) - min(x) for x in ([crc(r[2]) for r in rows], [crc(r[3]) for r in rows])]
    base = [min(crc(r[2]) for r in rows), min(crc(r[3]) for r in rows)]
    at = lambda r, d: (crc(r[2 + d]) - base[d]) / span[d]
    want = {}

    def cut(part, first, count):
        if count == 1:
            want.update({r[0]: first for r in part})
            return
        wide = max((0, 1), key=lambda d: max(at(r, d) for r in part) - min(at(r, d) for r in part))
        part = sorted(part, key=lambda r: (at(r, wide), r[0]))
        held, target = 0, sum(len(r[1]) + 1 for r in part) * (count // 2) / count
        for k, r in enumerate(part):
            if held + len(r[1]) + 1 >= target:
                k += held + len(r[1]) + 1 - target <= target - held
                break
            held += len(r[1]) + 1
        cut(part[:k], first, count // 2)
        cut(part[k:], first + count // 2, count - count // 2)

    cut(rows, 0, 8)
    assert got == want


def test_a_group_of_equal_rows_is_divided(docs_of):
    rows = [(i, "the same text") for i in range(300)] + [(1000 + i, "w" * (i % 37)) for i in range(300)]
    held = verify(rows, S.kd_shards(docs_of(rows), 8).collect(), 8)
    assert len(held) == 8 and max(held.values()) - min(held.values()) <= 80


def test_any_number_of_shards_and_edges(docs_of, edges, spark):
    rows = [(i, "x" * 9) for i in range(70)]
    held = verify(rows, S.kd_shards(docs_of(rows), 7).collect(), 7)
    assert set(held.values()) == {100}
    verify(edges, S.kd_shards(docs_of(edges), 4).collect(), 4)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert S.kd_shards(empty, 4).count() == 0
    verify([(1, "a")], S.kd_shards(docs_of([(1, "a")]), 16).collect(), 16)
