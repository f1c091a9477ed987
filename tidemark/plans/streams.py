"""Streaming forms, drained from the events table into the shared folder and read back."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidemark.functions.maths import tidy
from tidemark.operators import ordered as O
from tidemark.plans import patterns as T
from tidemark.plans import views as V
from tidemark.plans.registry import query, r
from tidemark.session import checkpoint_dir
from tidemark.streaming import stateful as K
from tidemark.streaming import streams as S


def _folders(spark, name):
    root = f"{checkpoint_dir(spark).rstrip('/')}/{name}_{os.urandom(6).hex()}"
    return f"{root}/out", f"{root}/state"


def _drain(spark, name, stream):
    return S.run_to_folder(stream, *_folders(spark, name))


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("stream_bars", f"""WITH RECURSIVE b AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)
SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, open, high, low, close, volume FROM b WHERE ts + INTERVAL 1 HOUR <= {_CLOSED}""")
def stream_bars(spark, sf):
    x = _drain(spark, "bars", S.tumbling_bars(S.read_ticks(spark, sf)))
    return x.select("symbol", F.unix_seconds("ts").alias("ts"), "open", "high", "low", "close", "volume")


@query("stream_sliding", f"""WITH RECURSIVE e AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) - to_hours(h) AS s, value FROM events, (VALUES (0), (1)) v(h)) SELECT symbol, CAST(epoch(s) AS BIGINT) AS start, count(*) AS n, {r('avg(value)','mean')} FROM e WHERE s + INTERVAL 2 HOUR <= {_CLOSED} GROUP BY 1, s""")
def stream_sliding(spark, sf):
    x = _drain(spark, "sliding", S.sliding_stats(S.read_ticks(spark, sf)))
    return x.select("symbol", F.unix_seconds("start").alias("start"), "n", tidy(F.col("mean")).alias("mean"))


@query("stream_sessions", f"""WITH RECURSIVE e AS (SELECT event_type AS symbol, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS nw FROM events), i AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY ts) AS s FROM e)
SELECT symbol, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM i GROUP BY symbol, s HAVING max(ts) + INTERVAL 1 HOUR <= {_CLOSED}""")
def stream_sessions(spark, sf):
    x = _drain(spark, "sessions", S.activity_sessions(S.read_ticks(spark, sf)))
    return x.select("symbol", F.unix_seconds("start").alias("start"), "n")


@query("stream_unique", "SELECT DISTINCT event_type AS symbol, event_id FROM events")
def stream_unique(spark, sf):
    """The events sent twice; the second copy is dropped."""
    t = S.read_ticks(spark, sf)
    return _drain(spark, "unique", S.unique_rows(t.unionByName(S.read_ticks(spark, sf)), ["event_id"])).select("symbol", "event_id")


@query("stream_contract", f"""WITH RECURSIVE e AS (SELECT event_type AS symbol, {V.roll_weekend('(CAST(et AS DATE) + CASE WHEN hour(et) >= 18 THEN 1 ELSE 0 END)')} AS day FROM (SELECT *, {V._ET.format('ts')} AS et FROM events))
SELECT symbol, 'C' || CAST((dayofyear(day) - 1) // 10 AS VARCHAR) AS contract, count(*) AS n FROM e GROUP BY 1, 2""")
def stream_contract(spark, sf):
    cal = V.bars1h(spark, sf).select("day", "contract").distinct()
    x = _drain(spark, "contract", S.with_contract(S.read_ticks(spark, sf), cal))
    return x.groupBy("symbol", "contract").agg(F.count(F.lit(1)).alias("n"))


@query("stream_session_state", f"""WITH RECURSIVE e AS (SELECT event_type AS symbol, value, {V.roll_weekend('(CAST(et AS DATE) + CASE WHEN hour(et) >= 18 THEN 1 ELSE 0 END)')} AS day FROM (SELECT *, {V._ET.format('ts')} AS et FROM events))
SELECT symbol, CAST(day AS VARCHAR) AS day, count(*) AS ticks, {r('avg(value)','mean_price')}, max(value) AS high, min(value) AS low FROM e GROUP BY 1, 2""")
def stream_session_state(spark, sf):
    """The last update of every (symbol, day), written by an idempotent foreachBatch."""
    folder, state = _folders(spark, "session_state")
    q = S.session_state(S.read_ticks(spark, sf)).writeStream.outputMode("update")
    save = lambda df, b: df.withColumn("batch", F.lit(b)).write.mode("overwrite").parquet(f"{folder}/part={b:012d}")
    q.foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    x = spark.read.schema("symbol STRING, day DATE, ticks BIGINT, mean_price DOUBLE, high DOUBLE, low DOUBLE, batch INT").parquet(f"{folder}/part=*")
    last = O.last_rows(x, ["symbol", "day"], F.col("batch"), ["ticks", "mean_price", "high", "low"])
    return last.select("symbol", F.col("day").cast("string").alias("day"), "ticks", tidy(F.col("mean_price")).alias("mean_price"), "high", "low")


@query("stream_upsert", """WITH RECURSIVE b AS (SELECT event_type AS symbol, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS ts, event_id FROM events) SELECT symbol, ts, max(event_id) AS event_id FROM b GROUP BY 1, 2""")
def stream_upsert(spark, sf):
    """Late rows win: newest batch, then newest row, per (symbol, hour)."""
    folder, state = _folders(spark, "upsert")
    t = S.read_ticks(spark, sf).withWatermark("ts", S.OVERLAP).select("symbol", (F.floor(F.unix_seconds("ts") / 3600) * 3600).alias("ts"), "event_id")
    S.upsert_log(t, folder, state).awaitTermination()
    log = spark.read.schema("symbol STRING, ts BIGINT, event_id BIGINT, batch INT").parquet(f"{folder}/part=*")
    return O.last_rows(log, ["symbol", "ts"], F.struct("batch", "event_id"), ["event_id"])


_STREAM_GAPS = V.sql("bars1h").replace("bars1h AS (", "bars_all AS (") + f", bars1h AS (SELECT * FROM bars_all WHERE ts <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM bars_all)), {T._LIFE_T}"


@query("stream_gaps", _STREAM_GAPS + """, mk AS (SELECT symbol, dir AS direction, CAST(epoch(ts) AS BIGINT) + 3600 AS born, unnest([{'m': 'created', 't': CAST(epoch(ts) AS BIGINT) + 3600, 'r': NULL}, {'m': 'entered', 't': ent_t, 'r': NULL}, {'m': 'partial', 't': par_t, 'r': NULL}, {'m': 'half', 't': half_t, 'r': NULL},
  {'m': 'full', 't': full_t, 'r': NULL}, {'m': 'validated', 't': val_t, 'r': NULL}, {'m': 'invalidated', 't': inv_t, 'r': NULL}, {'m': 'expired', 't': exp_t, 'r': NULL}, {'m': 'ended', 't': CASE WHEN reason <> 'data ended' THEN end_t END, 'r': reason}]) AS u FROM lt)
SELECT symbol, direction, born, u.m AS mark, CAST(u.t AS BIGINT) AS at, CAST(u.r AS VARCHAR) AS reason FROM mk WHERE u.t IS NOT NULL""")
def stream_gaps(spark, sf):
    """All marks of gaps from stored hourly candles replayed as a stream."""
    folder, state = _folders(spark, "gaps")
    b = V.bars1h(spark, sf).select("symbol", "day", "ts", "regime", "suspect", "after_gap", "high", "low", "close")
    src = folder.replace("/out", "/in")
    b.write.parquet(src)
    stream = spark.readStream.schema(b.schema).parquet(src)
    with K.rocksdb(spark):
        return S.run_to_folder(K.gap_lifecycle(stream, 3600), folder, state)


@query("stream_vwap", f"""WITH RECURSIVE b AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
d AS (SELECT *, {V.roll_weekend('(CAST(et AS DATE) + CASE WHEN hour(et) >= 18 THEN 1 ELSE 0 END)')} AS day FROM (SELECT *, {V._ET.format('ts')} AS et FROM b WHERE ts + INTERVAL 1 HOUR <= {_CLOSED}))
SELECT symbol, CAST(day AS VARCHAR) AS day, CAST(epoch(ts) AS BIGINT) AS ts, {r('sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w','vwap')}, CAST(sum(volume) OVER w AS DOUBLE) AS volume, max(high) OVER w AS high, min(low) OVER w AS low
FROM d WINDOW w AS (PARTITION BY symbol, day ORDER BY ts)""")
def stream_vwap(spark, sf):
    """The day's volume-weighted price at every closed candle."""
    with K.rocksdb(spark):
        x = _drain(spark, "vwap", K.session_vwap(S.read_ticks(spark, sf)))
    return x.select("symbol", F.col("day").cast("string").alias("day"), F.unix_seconds("ts").alias("ts"), tidy(F.col("vwap")).alias("vwap"), "volume", "high", "low")
