import zlib

import numpy as np
import pytest

from tidemark.llm import simple8b as S


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(S.default_file())


def brute(rows, bpe):
    """(doc_id, start, n_tokens, crc) in ascending order of ids, null first."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*bpe.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_every_document(documents, texts, bpe, spark, tmp_path):
    path = str(tmp_path / "t")
    got = S.round_trip(documents, path).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(brute(texts.items(), bpe))
    ids = {r.doc_id: r.ids for r in S.read_ids(spark, path).collect()}
    for i, t in texts.items():
        assert ids[i] == [*bpe.encode(t, add_special_tokens=False).ids, 1]


def test_edges(docs_of, edges, bpe, spark):
    rows = [*edges, (9, None), (9, "")]
    got = [tuple(r) for r in S.round_trip(docs_of(rows)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, bpe), key=str)
    assert S.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_with_most_rows_fills_several_slots(docs_of, bpe, spark):
    rows = [(7, f"text number {i}") for i in range(300)] + [(i, "other") for i in range(60)]
    found = S.round_trip(docs_of(rows)).collect()
    crc = sorted(r[3] for r in brute(rows, bpe) if r[0] == 7)
    assert sorted(r.ids_crc32 for r in found if r.doc_id == 7) == crc
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)] == sorted(r[0] for r in rows)


def test_words_hold_any_values():
    rng = np.random.default_rng(1)
    for t in range(200):
        lengths = rng.integers(1, 200, rng.integers(1, 6))
        n = lengths.sum()
        wide = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) >> rng.integers(0, 64, n).astype(np.uint64)
        values = [wide, rng.integers(0, 2, n).astype(np.uint64), rng.integers(0, 49408, n).astype(np.uint64)][t % 3]
        ends, _ = S.block_ends(lengths, 64)
        words, word_ends, escapes = S.encode(values, ends)
        assert set(escapes) == set(np.flatnonzero(values >= 1 << 60))
        assert (S.decode(words, word_ends, ends, escapes, values[escapes]) == values).all()
        b = int(rng.integers(len(ends)))  # one block alone, from its offset
        v0, w0 = (int(ends[b - 1]), int(word_ends[b - 1])) if b else (0, 0)
        inside = (escapes >= v0) & (escapes < ends[b])
        alone = S.decode(words[w0 : word_ends[b]], word_ends[b : b + 1] - w0, ends[b : b + 1] - v0, escapes[inside] - v0, values[escapes[inside]])
        assert (alone == values[v0 : ends[b]]).all()


def test_greedy_choice_takes_the_most_values():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << rng.integers(1, 21, 3000)).astype(np.uint64)
    ends, _ = S.block_ends(np.array([3000]), 500)
    words, word_ends, _ = S.encode(values, ends)
    at, want = 0, []
    for end in ends:
        while at < end:
            s = next(s for s, (c, b) in enumerate(zip(S.COUNTS, S.BITS)) if all(v < 1 << b for v in values[at : min(at + c, end)].tolist()))
            want.append(sum(int(v) << int(j * S.BITS[s]) for j, v in enumerate(values[at : min(at + S.COUNTS[s], end)])) | s << 60)
            at = min(at + S.COUNTS[s], end)
    assert words.tolist() == want


def test_words_one_by_one_equal_whole_texts(texts, bpe):
    encode = S.WordIds(S.default_file(), limit=500)
    rng = np.random.default_rng(3)
    letters = list("aB é.,'ß<|>́\nİΣ9漢-…—ÿ÷")
    odd = ["A<|endoftext|>B <|ENDOFTEXT|>", "J̌ ẖ H̱ é", "Σας ΟΔΟΣ İstanbul", "it's I'M we'Ll 's", "  x　y\x85z", "a.. \"e,\" (f). é, ü.", "\x00\x1c a", "x" * 3000]
    odd += ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(3000)]
    for text in [*texts.values(), *odd]:
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == bpe.encode(text, add_special_tokens=False).ids


def test_damaged_files_are_errors(documents, tmp_path):
    path = tmp_path / "t"
    S.write_ids(documents, str(path))
    content = bytearray(next((path / "ids").glob("part-*")).read_bytes())
    assert sum(len(f["ids"]) for f in S.read_frames(bytes(content)))
    content[len(content) // 2] ^= 1
    for bad in (bytes(content), bytes(content[:-9]), b"no frames"):
        with pytest.raises(ValueError):
            list(S.read_frames(bad))
