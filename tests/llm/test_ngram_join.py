import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import ngram_join as J

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """All pairs, every one compared."""
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def run(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.components(df).collect()}


def test_equals_brute_force_on_documents(documents, texts):
    assert run(documents) == brute(list(texts.items()))


def hard_rows(seed=4):
    """Groups of near copies around the threshold, chains of links, one passage in many texts, tiny texts."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(4000)}"
    passage, base, rows = [word() for _ in range(60)], [word() for _ in range(80)], []
    for _ in range(60):
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 3])):
            t[r.randrange(len(t))] = word()
        rows.append(t)
    chain = [word() for _ in range(60)]
    for _ in range(40):
        chain = chain[1:] + [word()] if r.random() < 0.5 else chain[2:] + [word(), word()]
        rows.append(list(chain))
    rows += [[word() for _ in range(r.randrange(5, 30))] + passage + [word() for _ in range(r.randrange(0, 30))] for _ in range(60)]
    rows += [[r.choice("abc") for _ in range(r.randrange(0, 8))] for _ in range(60)]
    r.shuffle(rows)
    return [(i * 3 + 1, " ".join(t).upper() if i % 2 else "  \n".join(t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [4, 5])
def test_equals_brute_force_on_hard_groups(docs_of, monkeypatch, seed):
    monkeypatch.setattr(J, "BLOCK_ENTRIES", 2000)
    rows = hard_rows(seed)
    assert run(docs_of(rows)) == brute(rows)


def test_edges(docs_of, edges, spark):
    got = J.components(docs_of(edges)).collect()
    assert len(got) == len(edges)
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3):
        assert (by[i].n_shingles, by[i].component_id) == (0, i)
    assert by[4].n_shingles == 1 and by[5].component_id == 5 and by[8].n_shingles == 1
    assert J.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert J.components(docs_of([(1, None), (2, "")])).count() == 2


def test_one_of_each_group_stays_with_all_columns(docs_of, edges):
    rows = hard_rows(9)
    df = docs_of(rows + [rows[0], (None, "x y z"), (None, "x y z")])
    out = J.keep_one(df)
    assert out.columns == df.columns
    want = sorted({c if n else i for i, (n, c) in brute(rows).items()})
    assert sorted(r.doc_id for r in out.where("doc_id is not null").collect()) == want
    assert out.where("doc_id is null").count() == 2 and out.where(F.col("_drop") & (F.col("_n") == "x")).count() == len(want) + 2
