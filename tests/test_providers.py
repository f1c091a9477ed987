"""Providers: own formats, failures that stay their own."""

from pyspark.sql import functions as F

from tidemark.sources import providers as P


def test_a_failing_provider_leaves_the_others(spark, tmp_path):
    a = spark.range(7).select("id", F.lit('a, "b"\nc').alias("title"), F.lit("http://x").alias("url"), F.lit("s").alias("source_name"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("published"))
    a.write.json(f"{tmp_path}/j")
    a.limit(3).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(f"{tmp_path}/c")
    a.limit(0).write.json(f"{tmp_path}/none")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/part-0.json").write_text('{"id": 1}\n{"id": ')
    P.REGISTRY["keyed"] = P.Provider("keyed", "k", "k", P.json_wire, "A_KEY")
    asked = [("one", "json_wire", f"{tmp_path}/j"), ("two", "csv_table", f"{tmp_path}/c"), ("three", "json_wire", f"{tmp_path}/bad"), ("four", "rss", f"{tmp_path}/gone"), ("five", "keyed", f"{tmp_path}/j"), ("six", "nobody", ""), ("seven", "json_wire", f"{tmp_path}/none")]
    try:
        articles, status = P.fetch(spark, asked)
        got = {r.provider: r for r in status.collect()}
        assert {k: (r.n, r.status) for k, r in got.items()} == {"one": (7, "ok"), "two": (3, "ok"), "three": (0, "error"), "four": (0, "error"), "five": (0, "not configured"), "six": (0, "error"), "seven": (0, "empty")}
        assert all((r.why is None) == (r.status in ("ok", "empty")) and len(r.why or "") <= P.MESSAGE for r in got.values())
        assert articles.count() == 10 and {r.title for r in articles.select("title").distinct().collect()} == {'a, "b"\nc'}
        assert {r.provider: r.n for r in P.fetch(spark, asked, {"A_KEY"})[1].collect()}["five"] == 7
        assert P.fetch(spark, [])[1].count() == 0
    finally:
        del P.REGISTRY["keyed"]
