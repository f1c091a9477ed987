import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.llm import ngram_join, quality_mil, toxicity


def test_all_operators_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_every_stage_does_its_work(spark, sf, tmp_path):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in C.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id for r in out.select("doc_id").distinct().collect()}
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.score_documents(docs, labels).where("predicted = 0").collect()}
        elif name == "quality":
            want = {r.doc_id for r in quality_mil.score_documents(docs, labels).where("score >= 0.5").collect()}
        elif name == "near_duplicates":
            want = {r.component_id for r in ngram_join.components(docs).collect()}
        else:
            want = before
        assert after == want and after <= before
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    run = C.run(spark, sf)
    same = lambda df: sorted(tuple(r) for r in df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect())
    assert same(run) == same(docs)


@pytest.mark.parametrize("stage", [f for _, f in C.STAGES], ids=[n for n, _ in C.STAGES])
def test_stages_on_edges(spark, sf, docs_of, edges, stage):
    df = docs_of(edges)
    out = stage(spark, df, sf)
    assert out.count() <= 3000 and ("start" in out.columns or out.columns == df.columns)
    assert stage(spark, df.limit(0), sf).count() == 0
