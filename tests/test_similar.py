"""Similar titles in blocks: equal to all pairs whatever the size of a block, and nothing but results leaves a cell."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import news as N
from tidemark.operators import similar as S
from tidemark.operators.graph import connected_components


def _titles(spark, n=160, seed=3):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, t0 + dt.timedelta(hours=rng.randint(0, 300)), rng.sample(words, rng.randint(2, 9))) for i in range(n)]
    rows += [(1000 + i, t0 + dt.timedelta(hours=25 * i), ["w1", "w2", "w3", "w4"]) for i in range(12)]
    return spark.createDataFrame(rows, "id long, published timestamp, tokens array<string>"), rows


def _wanted(rows, weights):
    idf = {r.token: r.idf for r in weights.collect()}
    want = {}
    for (i, t, a), (j, u, b) in itertools.combinations(sorted(rows), 2):
        both = set(a) & set(b)
        if abs(t - u) <= dt.timedelta(hours=72) and min(len(a), len(b)) >= 3 and len(both) >= 2:
            s = sum(idf[x] for x in both) / min(sum(idf[x] for x in a), sum(idf[x] for x in b))
            if s >= 0.5 - 1e-12:
                want[i, j] = (len(both), round(s, 9))
    return want


@pytest.mark.parametrize("size", [1 << 21, 60])
def test_every_pair_of_articles_is_listed_copies_too(spark, monkeypatch, size):
    """A row that comes twice is one article."""
    monkeypatch.setattr(S, "BLOCK_TOKENS", size)
    articles, rows = _titles(spark)
    weights = N.token_weights(articles)
    nodes, members = N.headline_nodes(articles, weights)
    assert nodes.count() < len([r for r in rows if len(r[2]) >= 3])
    got = N.similar_nodes(nodes, members=members.unionByName(members.limit(5))).collect()
    want = _wanted(rows, weights)
    assert {(r.a, r.b): (r.shared, round(r.similarity, 9)) for r in got} == want and len(got) == len(want)
    assert (1000, 1001) in want and want[1000, 1001] == (4, 1.0)


@pytest.mark.parametrize("size", [1 << 21, 40])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, size):
    monkeypatch.setattr(S, "BLOCK_TOKENS", size)
    articles, _ = _titles(spark)
    nodes, _ = N.headline_nodes(articles, N.token_weights(articles))
    pairs, links = N.similar_nodes(nodes), N.similar_nodes(nodes, linked=True)
    ids = nodes.select(F.col("node").alias("id"))
    of = lambda edges: {r.id: r.component for r in connected_components(edges, ids).collect()}
    got = of(links)
    assert got == of(pairs) and len(set(got.values())) < len(got)


def test_a_hundred_near_copies_are_linked_by_few_pairs(spark):
    """All pairs of a group are its links' square; one cell gives one less than it connects."""
    rows = [(i, dt.datetime(2024, 1, 1), ["alpha", "beta", "gamma", "delta", "omega", "sigma", f"x{i}"]) for i in range(100)]
    articles = spark.createDataFrame(rows, "id long, published timestamp, tokens array<string>")
    nodes, _ = N.headline_nodes(articles, N.token_weights(articles))
    assert N.similar_nodes(nodes).count() == 4950 and N.similar_nodes(nodes, linked=True).count() == 99


def test_candidates_are_not_shuffled(spark):
    articles, _ = _titles(spark, 30)
    nodes, _ = N.headline_nodes(articles, N.token_weights(articles))
    plan = N.similar_nodes(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_small_steps_find_the_same(monkeypatch):
    """Meetings and pairs of copies are looked at in slices; what is found does not depend on their size."""
    import pyarrow as pa

    rng = random.Random(5)
    sets = [sorted(rng.sample(range(30), rng.randint(3, 8))) for _ in range(40)]
    tw = [[{"neg": -1.0 - t / 10, "token": f"w{t}"} for t in sorted(s, reverse=True)] for s in sets]
    place = {c: [v] * 40 for c, v in (("bucket", 0), ("part", 0), ("before", 0), ("own", 1), ("after", 0))}
    items = [[{"id": 100 * i + c, "t0": c, "t1": c} for c in range(1 + i % 4)] for i in range(40)]
    kind = pa.list_(pa.struct([("neg", pa.float64()), ("token", pa.string())]))
    table = pa.table({**place, "tw": pa.array(tw, kind), "items": items, "total": [-sum(e["neg"] for e in x) for x in tw], "k": [*range(40)], "fresh": [True] * 40})
    row = S._pack(table).to_pylist()[0] | {"cell": {"b": 0, "i": 0, "c": 0, "j": 0}}

    def found():
        cell = pa.RecordBatch.from_pylist([row])
        return sorted(tuple(r.values()) for b in S._cell(iter([cell]), ["a", "b", "shared", "similarity"], 259200, 0.5, 2, None, False) for r in b.to_pylist())

    whole = found()
    monkeypatch.setattr(S, "STEP", 3)
    assert found() == whole and len(whole) > 100
