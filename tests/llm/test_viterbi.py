import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import viterbi as V


@pytest.fixture(scope="module")
def model():
    return V.Model.load(V.default_model())


def brute(m, text):
    """The best segmentation by a table over the whole text."""
    if not text:
        return []
    b = (" " + text).encode()
    best, back = [0.0] + [-1e300] * len(b), [None] * (len(b) + 1)
    for e in range(1, len(b) + 1):
        if e < len(b) and b[e] & 0xC0 == 0x80:
            continue
        for s in range(max(0, e - m.longest), e):
            i = m.ids.get(b[s:e])
            if i is not None and best[s] + m.score[i] > best[e]:
                best[e], back[e] = best[s] + m.score[i], (s, i)
        s = e - 1
        while b[s] & 0xC0 == 0x80:
            s -= 1
        if b[s:e] not in m.ids and best[s] + m.fallback > best[e]:
            best[e], back[e] = best[s] + m.fallback, (s, -1)
    out, e = [], len(b)
    while e:
        s, i = back[e]
        out.append([i] if i >= 0 else [int(m.byte_id[x]) for x in b[s:e]])
        e = s
    return [x for y in reversed(out) for x in y]


def odd_texts():
    r = random.Random(1)
    made = ["".join(r.choice(["a", "b", "the", "ing", " ", "é", "字", "\n", ".", "▁", "🙂"]) for _ in range(r.randint(0, 150))) for _ in range(120)]
    return ["", "a", " ", "  a  b", "\n\n", "▁ x▁", "漢字かな交じり文", " " * 200, "x" * 500, "https://abc.def/" + "q1w2e3" * 40, "é" * 90, "tab\there", "🙂🙂 hi", "ab " * 30, *made]


def test_lanes_streams_and_brute_force_agree(model):
    texts = odd_texts()
    ids, cuts = V.encode_run(model, pa.array(texts, pa.large_string()))
    for t, a, b in zip(texts, cuts[:-1], cuts[1:]):
        want = brute(model, t)
        assert list(ids[a:b]) == want
        if t:
            stream = V.Stream(model)
            assert [*stream.feed((" " + t).encode()), *stream.end()] == want
    assert V.decode_run(model, ids, cuts).to_pylist() == texts


def test_a_stream_commits_early_and_keeps_a_bounded_window(model, texts):
    long, stream, early, widest = " ".join(texts.values())[:60_000], V.Stream(model), 0, 0
    for word in long.split(" "):
        early += len(list(stream.feed((" " + word).encode())))
        widest = max(widest, stream.held)
    assert early > 0.99 * (early + len(list(stream.end()))) and widest < 800


def test_paths_that_never_meet_take_linear_time_and_two_bytes_a_byte(model):
    start, stream, n = time.perf_counter(), V.Stream(model), 300_000
    got = [*stream.feed(b"a" * n)]
    assert stream.held <= 2 * n + 1 and len(stream.score) <= model.longest + 1
    got += stream.end()
    assert time.perf_counter() - start < 30
    assert b"".join(model.bytes_of[i] for i in got) == b"a" * n
    for size in (65, 130, 700):
        stream = V.Stream(model)
        assert [*stream.feed((" " + "a" * size).encode()), *stream.end()] == brute(model, "a" * size)


def test_words_of_one_hash_are_told_apart_by_their_bytes(model, monkeypatch):
    texts = ["the the cat", "sat on mat", "mat cat the"]
    monkeypatch.setattr(V.Texts, "hash_spans", lambda t, a, b: (b - a).astype("u8"))
    t = V.Texts.of(pa.array([" " + x for x in texts], pa.large_string()))
    start = np.flatnonzero(t.data == 32)
    end = np.append(start[1:], len(t.data))
    _, pick, word = np.unique(t.hash_spans(start, end), return_index=True, return_inverse=True)
    pick, word = V._told_apart(t, start, end, pick, word)
    assert [bytes(t.data[start[p] : end[p]]) for p in pick[word]] == [bytes(t.data[a:b]) for a, b in zip(start, end)]


def test_documents_round_trip(documents, texts, model, spark):
    coded = V.encode(documents)
    assert {r.doc_id: r.text for r in V.decode(coded).collect()} == texts
    some = {r.doc_id: r.ids for r in coded.where("doc_id < 25").collect()}
    assert all(ids == brute(model, texts[i]) for i, ids in some.items())
    assert V.round_trip(documents).where("not exact or text_crc32 <> decoded_crc32").count() == 0


def test_edges(docs_of, edges, spark):
    got = V.round_trip(docs_of(edges)).collect()
    assert len(got) == len(edges) and all(r.exact for r in got)
    assert {r.n_ids for r in got if r.doc_id in (1, 2)} == {0}
    assert V.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.text for r in V.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()] == ["", ""]
