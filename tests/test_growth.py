"""Work that follows the size of the input: one reading, no token tables in the driver, tasks of bounded size."""

import datetime as dt

from tidemark.operators import documents as D
from tidemark.operators import names as E
from tidemark.operators import news as N
from tidemark.plans import load

load()  # the query modules refer to each other
from tidemark.plans import holdings, newsroom  # noqa: E402


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_tables_of_headlines_are_not_broadcast(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0, ["alpha", "beta", "gamma", f"w{i % 3}"]) for i in range(6)]
    articles = spark.createDataFrame(rows, "id long, published timestamp, tokens array<string>")
    pairs = N.similar_nodes(N.headline_nodes(articles, N.token_weights(articles))[0])
    assert "BroadcastHashJoin" not in _plan(pairs)
    assert {(r.a, r.b) for r in pairs.collect()} == {(0, 1), (0, 2), (1, 2)}


def test_factors_without_a_strength_are_counted_with_their_evidence(spark):
    rows = [(1, "geo:China", "geography", f"s{i % 3}", None) for i in range(4)] + [(1, "geo:Japan", "geography", "s0", None), (2, "geo:China", "geography", "s9", "disclosed")]
    x = spark.createDataFrame(rows, "holding int, factor_key string, kind string, evidence string, strength string")
    got = {(r.holding, r.factor_key): (r.strength, r.pieces, r.evidence) for r in D.assemble_factors([x]).collect()}
    assert got == {(1, "geo:China"): ("emphasized", 4, ["s0", "s1", "s2"]), (1, "geo:Japan"): ("mentioned", 1, ["s0"]), (2, "geo:China"): ("disclosed", 1, ["s9"])}
    assert "Join" not in _plan(D.assemble_factors([x]))


def test_dependencies_read_the_sentences_once(spark):
    sent = "We rely on Taiwan Semiconductor Manufacturing as our sole-source foundry for wafers, number {}."
    scoped = spark.createDataFrame([(1, i, "Business", None, sent.format(i)) for i in range(5)], "doc_id int, pos int, section string, subsection string, sent string")
    own = spark.createDataFrame([(1, "Acme", "ACME")], "doc_id int, company string, ticker string")
    d = D.dependencies(scoped, own)
    assert "Window" not in _plan(d) and _plan(d).count("Join") == 1
    row = d.first()
    assert row.mentions >= 5 and [e.text for e in row.evidence] == [sent.format(i) for i in range(3)]


def test_brand_lines_use_more_tasks_for_more_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(holdings, "LINES_A_TASK", 10)
    spark.createDataFrame([(i % 50, i % 7) for i in range(400)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"p{i % 2}") for i in range(50)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i, f"Brand#{i}") for i in range(7)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    x = holdings._brand_lines(spark, str(tmp_path))
    assert "hashpartitioning(l_orderkey" in _plan(x) and ", 40)" in _plan(x)
    want = {}
    for i in range(400):
        k = (f"p{i % 50 % 2}", i % 7)
        want[k] = want.get(k, 0) + 1
    assert {(r.holding, r.b): r.n for r in x.collect()} == want


def test_event_store_reads_stored_events(spark, tmp_path):
    rows = [(10 * i, i % 3, dt.datetime(1999, 5, 1 + i % 20)) for i in range(60)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    x = newsroom.event_store(spark, str(tmp_path))
    assert "min_by" not in _plan(x)
    assert {(r.id, r.stored_at) for r in x.collect()} == {(f"{k}-1999", 2) for k in range(3)}


def test_names_of_all_lengths_in_one_reading(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Acme Corp of Peru pays ACME; Zeta waits for Acme Corp."), (2, None), (3, "")], "doc_id long, text string")
    aliases = spark.createDataFrame([("acme", "A"), ("acme corp", "AC"), ("acme corp of peru", "ACP"), ("zeta", "Z")], "alias string, ticker string")
    found = E.name_mentions(texts, aliases)
    assert "Union" not in _plan(found)
    got = sorted(map(tuple, found.collect()))
    assert [g[1:] for g in got] == [("A", "acme", 6), ("AC", "acme corp", 10), ("ACP", "acme corp of peru", 1), ("Z", "zeta", 7)]
    monkeypatch.setattr(E, "FIRST_WORDS", 0)
    assert sorted(map(tuple, E.name_mentions(texts, aliases).collect())) == got


def test_matters_read_their_texts_once(spark):
    day = dt.date.fromisoformat
    rows = [("E", day("2025-03-03"), f"A class action lawsuit was filed in the district court over number {i}.") for i in range(3)] + [("E", None, "A class action lawsuit was filed in the district court."), ("E", day("2025-03-04"), "Layoffs were filed with the court of appeal.")]
    paras = D.paragraph_matters(spark.createDataFrame(rows, "company string, filed date, text string"))
    assert "ExistingRDD" in _plan(paras)
    x = D.linked_matters([paras, paras])
    assert "RLIKE" not in _plan(x) and "ExistingRDD" not in _plan(x)
    assert sorted((str(r.first_date), r.sources, r.origins) for r in x.collect()) == [("2025-03-03", 3, "annual report"), ("None", 1, "annual report")]
