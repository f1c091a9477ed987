import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of (doc_id, text) as a documents table with columns whose names the operators use themselves."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, node long, score double, _id long, _drop boolean, _n string, shard int, sigs string, label int, kept boolean"
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 0.5, 7, True, "x", 3, "y", 1, False) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def edges():
    """Null, empty, blank and very long texts, ties, a repeated row, a null id."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "a b c d e f g h a b c d e f g h"), (5, "a b c d e f g h a b c d e f g h"), (None, "no id here, only text that is long enough to matter a little."), (7, "é漢字🙂 " * 300), (8, "x" * 200_000)]
