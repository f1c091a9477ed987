import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lexical as X


def brute(docs, items, top=20):
    """Per item the (rank, doc_id, score) list, document by document."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    found = [(d, Counter(words(t))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in found:
            m = 75 + 25 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, 9, 1) for i, t in items], "item_id long, text string, rank int, score long")


def test_equals_brute_force(documents, texts, spark, sf, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute(texts.items(), [(r.item_id, r.text) for r in items.collect()])
    assert len(want) > 20 and rows(X.search(documents, items)) == want
    monkeypatch.setattr(X, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(X, "RUN_CELLS", 3000)
    assert rows(X.search(documents, items)) == want


def test_edges(docs_of, edges, spark):
    docs = [*edges, (11, "Word word WORD É é"), (10, "word word word É é"), (12, "_word-word!word É é"), (13, "日本 a1b2\x00c")]
    items = [(1, "word É"), (1, "word word x"), (None, "a B c"), (2, None), (3, " ,;"), (4, "nowhere"), (5, "日本 c a1b2"), (6, "é漢字🙂 " * 50)]
    assert rows(X.search(docs_of(docs), items_of(spark, items), 3)) == brute(docs, items, 3)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert X.search(empty, items_of(spark, items)).count() == 0
    assert X.search(docs_of(docs), items_of(spark, [])).count() == 0
    assert X.search(docs_of([(1, None), (2, " ")]), items_of(spark, items)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_shared_sums_equal_plain_sums(seed):
    rng = random.Random(seed)
    common = [rng.sample(range(40), rng.randint(2, 9)) for _ in range(4)]
    items = [{t: rng.choice([1, 1, 1, 2]) for t in {*rng.choice(common), *rng.choice(common), *rng.sample(range(40), rng.randint(0, 5))}} for _ in range(25)] + [{}]
    scores = np.random.default_rng(seed).integers(0, 1000, (40, 6))
    dag = X.share(items)
    want = [sum((scores[t] * k for t, k in item.items()), np.zeros(6, np.int64)) for item in items]
    assert (dag.sums(scores) == np.array(want)).all()
    assert dag.additions < sum(max(len(i) - 1, 0) for i in items)
    below = len(dag.atoms)
    for i, parts in enumerate(dag.edges):
        assert all(p < below + i for p in parts)
    for i, a in enumerate(dag.edges):  # nothing that two rows share is summed twice
        assert all(len(set(a) & set(b)) < 2 for b in dag.edges[:i]) or a in dag.edges[:i]


def test_shared_terms_are_summed_once():
    dag = X.share([{t: 1 for t in range(10)} | {20 + i: 1} for i in range(5)])
    assert dag.additions == 9 + 5


def test_known_terms_are_held_to_their_bytes(monkeypatch):
    words = ["alpha", "beta", "éa", "x" * 30]
    monkeypatch.setattr(X.TermTexts, "words", property(lambda t: np.zeros(len(t.spans[0]), np.uint64)))  # every hash alike
    for w in words:
        text = X.TermTexts.of(pa.array([f"alphb {w} beto ea {w}x"], pa.large_string()), lower=True)
        hit, number = X.Vocabulary([w]).find(text)
        assert hit.tolist() == [1] and number.tolist() == [0]
