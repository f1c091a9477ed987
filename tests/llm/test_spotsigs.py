import hashlib
import re

from tidemark.llm import spotsigs as S

ANCHORS = set(S.ANCHORS)


def signatures(text):
    words = [x for x in re.split(r"[^\w]|_", text.lower()) if x]
    content, out, k = [x for x in words if x not in ANCHORS], set(), 0
    for i, x in enumerate(words):
        if x in ANCHORS:
            if i - k + 2 <= len(content):
                out.add((x, content[i - k], content[i - k + 1]))
            k += 1
    return out or {text.lower()}


def verify(rows, got):
    rows = sorted(rows)
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for j, (i, t) in enumerate(rows):
        nxt = rows[(j + 1) % len(rows)][1] or ""
        t = t or ""
        half = len(t) // 2
        edited, r = t[: len(t) - half] + nxt[:half], by[i]
        a, b, c = signatures(t), signatures(edited), signatures(nxt)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == 8 * len(a) and len(r.edited_fingerprint) == 8 * len(b)
        assert abs(r.near_edited - len(a & b) / len(a | b)) < 1e-9 and abs(r.near_next - len(a & c) / len(a | c)) < 1e-9


def test_equals_brute_force(documents, texts):
    verify(list(texts.items()), S.fingerprints(documents).collect())


def test_blocks_of_ids_of_any_spacing(docs_of, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_DOCS", 2)
    ids = [*range(200), 10**6, 10**12, *range(10**12 + 5, 10**12 + 90), 4 * 10**18]
    rows = [(i, f"the cat {i} of town {i % 7} is on the mat {i % 11} and it was red") for i in ids]
    verify(rows, S.fingerprints(docs_of(rows)).collect())


def test_equal_texts_have_equal_fingerprints(docs_of):
    rows = [(i, ["the big dog and the small cat", None, "", "...", "no anchors"][i % 5]) for i in range(20)]
    got = S.fingerprints(docs_of(rows)).collect()
    for k in range(5):
        assert len({r.fingerprint for r in got if r.doc_id % 5 == k}) == 1
    assert len({r.fingerprint for r in got}) == 4


def test_edges(docs_of, edges, spark):
    got = S.fingerprints(docs_of(edges)).collect()
    assert len(got) == len(edges) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert S.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = S.fingerprints(docs_of([(3, "the one and only")])).first()
    assert alone.near_next == 1.0


def test_near_duplicates_equal_brute_force(docs_of, documents, texts):
    import random

    r = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    base = " ".join(r.choice(["the", "of", r.choice(words), r.choice(words)]) for _ in range(200))
    made = []
    for _ in range(50):
        t = base.split()
        for _ in range(r.choice([0, 1, 2, 4, 8])):
            t[r.randrange(len(t))] = r.choice(words)
        made.append(" ".join(t))
    rows = [*enumerate(made), (100, made[0]), (101, None), (102, ""), (103, "x"), *[(1000 + i, t) for i, t in texts.items()]]
    sets, up = {i: signatures(t or "") for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_signatures, r.group_id) for r in S.near_duplicates(docs_of(rows)).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in ids}
    assert len({g for _, g in got.values()}) < len(ids) - 20
