"""Readers for candle CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal

# Fixed value: the CSV header, contract optional.
BAR_COLUMNS = "timestamp STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, contract STRING"


def parse_stamp(c: Column) -> Column:
    """Unix seconds or ISO-8601 with a zone; anything else is null."""
    seconds = F.timestamp_seconds(F.try_to_number(F.trim(c), F.lit("99999999999")))
    zoned = F.when(F.trim(c).rlike(r"(Z|[+-]\d\d:?\d\d)$"), c.try_cast("timestamp"))
    return F.coalesce(seconds, zoned)


def read_bars_csv(spark: SparkSession, path: str, interval: str, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Candles of one symbol, or of all in folders ``symbol=...``; rows with unreadable stamps are skipped; range is [start, end)."""
    raw = spark.read.schema(BAR_COLUMNS).option("header", True).option("enforceSchema", True).csv(path)
    df = raw.withColumn("ts", parse_stamp(F.col("timestamp"))).filter("ts is not null").drop("timestamp")
    if start:
        df = df.filter(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        df = df.filter(F.col("ts") < F.lit(end).cast("timestamp"))
    df = df if symbol is None else df.withColumn("symbol", F.lit(symbol))
    return df.withColumn("interval", F.lit(interval))


def et_to_utc(df: DataFrame, column: str) -> DataFrame:
    """Vendor stamps in New York wall clock at candle start -> UTC."""
    return df.withColumn(column, cal.from_et(F.col(column)))
