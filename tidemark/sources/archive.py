"""Candle archive: merge, catalogue, partitioned storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERLAP_HOURS = 6  # fixed value: re-read this much when refreshing


def merge_archive(old: DataFrame, fresh: DataFrame, now: Column | None = None, step: int = 0) -> DataFrame:
    """Newer batch wins per (symbol, interval, ts); the still-forming newest candle stays out.

    A partial aggregate instead of a window, so a stamp repeated in many batches combines map-side.
    """
    if now is not None:
        fresh = fresh.filter(F.unix_seconds("ts") + step <= F.unix_seconds(now))
    keys = ["symbol", "interval", "ts"]
    both = old.unionByName(fresh)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def refresh_from(archive: DataFrame) -> DataFrame:
    """Where the next incremental read of every series starts."""
    return archive.groupBy("symbol", "interval").agg((F.max("ts") - F.expr(f"interval {OVERLAP_HOURS} hours")).alias("read_from"))


def catalog(archive: DataFrame) -> DataFrame:
    """First, last, size and rows of the newest batch per series."""
    newest = archive.groupBy("symbol", "interval").agg(F.max("batch").alias("_m"))
    x = archive.join(newest, ["symbol", "interval"])
    return x.groupBy("symbol", "interval").agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("bars"), F.count_if(F.col("batch") == F.col("_m")).alias("new_rows"))


def write_archive(archive: DataFrame, path: str) -> None:
    """Parquet by (symbol, month): only touched partitions are replaced."""
    out = archive.withColumn("month", F.date_format("ts", "yyyy-MM"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "month").parquet(path)


def retain(articles: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Keep recent articles, one per URL (the first seen)."""
    rest = [c for c in articles.columns if c != "url"]
    x = articles.filter(F.col("published") >= now - F.expr(f"interval {days} days"))
    return x.groupBy("url").agg(F.min_by(F.struct(*rest), "arrival").alias("_r")).select("url", "_r.*")


def store_events(old: DataFrame, new: DataFrame, key: str = "id", version: str = "stored_at") -> DataFrame:
    """Every material event once, the last write winning."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(key, "_r.*")


def events_between(store: DataFrame, start: str, end: str, column: str = "published") -> DataFrame:
    d = F.to_date(column)
    return store.filter((d >= F.lit(start).cast("date")) & (d <= F.lit(end).cast("date")))
