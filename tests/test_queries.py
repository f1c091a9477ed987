"""The registered queries: contract, smoke, a few against SQL, streams against batch."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracle import TABLES, table_rows

SAMPLE = ["experiment", "bootstrap_ci", "dq_moves", "resample", "fvg_states", "structure", "setups", "barrier_outcome", "concentration", "merge_histories", "sentences", "news_dedupe", "news_clusters", "stream_bars"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "symbol" and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    assert table_rows(df.columns, [tuple(x) for x in df.collect()]) == table_rows([d[0] for d in cur.description], cur.fetchall())


def test_smt_compares_every_symbol(spark, sf, tmp_path):
    """An event type that no list names is compared like the others."""
    events = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/events.parquet")
    events.withColumn("event_type", F.when(F.col("event_type") == "click", "tap").otherwise(F.col("event_type"))).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    df = entry.queries()["smt"](spark, str(tmp_path))
    cur = con.execute(entry.oracle_sql()["smt"])
    got, want = table_rows(df.columns, [tuple(x) for x in df.collect()]), table_rows([d[0] for d in cur.description], cur.fetchall())
    assert got == want and any("tap" in row for row in got[1])


def test_batches_sources_and_baskets_read_every_row(spark, sf):
    """Row counts of the inputs add up on both sides of each merge."""
    from tidemark.operators import bars as B
    from tidemark.plans import holdings, intraday, newsroom, reported
    from tidemark.plans import views as V

    ticks = V.ticks(spark, sf)
    stamps = B.bars_from_ticks(ticks, intraday.STEP).select("symbol", "ts").filter(F.unix_seconds("ts") + intraday.STEP <= F.unix_seconds(F.lit("2024-01-30 12:30:00").cast("timestamp")))
    archive = intraday._archive(spark, sf).select("symbol", "ts")
    assert archive.count() == stamps.count() and not archive.exceptAll(stamps).count()
    first, second = reported._sources(spark, sf)
    annual = reported._annual(spark, sf)
    in_second = second.select("entity", F.expr("date_add(date, cast(entity % 15 as int))").alias("date"))
    assert not annual.select("entity", "date").exceptAll(first.select("entity", "date").union(in_second).distinct()).count()
    assert first.count() < annual.count() and second.count() < annual.count()
    total = V.table(spark, sf, "orders").agg(F.sum("o_totalprice")).collect()[0][0]
    assert holdings.raw_basket(spark, sf).count() == 25
    assert holdings.raw_basket(spark, sf).agg(F.sum("full_weight").alias("v")).first().v == pytest.approx(float(total) / 1e8, rel=0.01)
    a = newsroom.articles(spark, sf)
    words = lambda c: F.size(F.split(F.trim(c), " +"))
    kept = a.select("id", F.concat_ws(" ", "title", "summary").alias("t"))
    texts = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("w"))
    assert not kept.join(texts, "id").filter(words(F.col("t")) != words(F.col("w"))).count()
