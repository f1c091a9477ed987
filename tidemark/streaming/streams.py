"""Streaming forms of the same operators.  A window leaves only when it is closed, so results equal the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal

TICK_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
LATE = "10 minutes"
OVERLAP = "6 hours"


def read_ticks(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    raw = spark.readStream.schema(TICK_SCHEMA).option("pathGlobFilter", pattern).parquet(folder)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", F.col("value").alias("price"))


def tumbling_bars(ticks: DataFrame, size: str = "1 hour", late: str = LATE) -> DataFrame:
    """OHLCV per window, emitted once the watermark has passed its end."""
    pos = F.struct("ts", "event_id")
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", size).alias("w")).agg(
        F.min_by("price", pos).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", pos).alias("close"), F.count(F.lit(1)).alias("volume"))
    return g.select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("closed_at"), "open", "high", "low", "close", "volume")


def sliding_stats(ticks: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str = LATE) -> DataFrame:
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"))
    return g.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def activity_sessions(ticks: DataFrame, gap: str = "1 hour", late: str = LATE) -> DataFrame:
    """Stretches of activity closed by a pause longer than ``gap``."""
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique_rows(ticks: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def with_contract(ticks: DataFrame, contracts: DataFrame) -> DataFrame:
    """Stream-static join with the contract calendar (symbol-free, one row per trading day)."""
    return ticks.withColumn("day", cal.trading_day(F.col("ts"))).join(contracts, "day", "left")


def session_state(ticks: DataFrame) -> DataFrame:
    """Running mean price, high and low per (symbol, trading day), updated with every micro-batch.

    A plain aggregation, so ticks combine map-side before they meet.  The day's end is the event time
    of the group: once the watermark passes it, the day's state is dropped.
    """
    x = ticks.withColumn("day", cal.trading_day(F.col("ts"))).withColumn("day_end", cal.from_et(F.timestamp_seconds(F.unix_date("day") * 86400 + 17 * 3600)))
    g = x.withWatermark("day_end", "1 day").groupBy("symbol", "day", "day_end")
    return g.agg(F.count(F.lit(1)).alias("ticks"), F.avg("price").alias("mean_price"), F.max("price").alias("high"), F.min("price").alias("low")).drop("day_end")


def upsert_log(stream: DataFrame, folder: str, checkpoint: str):
    """foreachBatch writer: every micro-batch replaces its own part, so a repeated batch changes nothing.

    Reading the log and taking the newest batch per key gives the merged archive.
    """
    def save(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/part={batch_id:012d}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str, schema: str | None = None) -> DataFrame:
    """Drain a stream into Parquet and read the result back."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(folder)
