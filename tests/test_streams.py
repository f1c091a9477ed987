"""Keyed streams against their batch forms, with late, repeated and unordered rows and a restart."""

import os
import random

import pytest
from pyspark.sql import functions as F

from helpers import minutes, random_bars
from tidemark.functions import calendar as cal
from tidemark.operators import bars as B
from tidemark.operators import detectors as D
from tidemark.streaming import stateful as K
from tidemark.streaming import streams as S

COLUMNS = ["symbol", "ts", "day", "regime", "suspect", "after_gap", "high", "low", "close"]


def files(frames, folder):
    """One file for each micro-batch, in order."""
    for i, f in enumerate(frames):
        f.coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):
            if name.startswith("part-"):
                os.rename(f"{folder}/{name}", f"{folder}/b{i:03d}.parquet")
                os.utime(f"{folder}/b{i:03d}.parquet", (1_000_000 + i, 1_000_000 + i))


def drain(stream, path):
    return S.run_to_folder(stream, f"{path}/out", f"{path}/state")


@pytest.fixture(scope="module")
def bars(spark):
    b = minutes(spark, random_bars(400, 11), start="2026-09-29 20:00:00", suspect={60, 61, 200}).withColumn("regime", F.when(F.col("bar_no") > 250, 1).otherwise(0))
    return b.withColumn("atr", F.lit(None).cast("double")).cache()


def batch_marks(bars):
    life = D.fvg_states(D.fvg(bars, 60), bars, 60)
    want = set()
    for r in life.collect():
        born = int(r.confirmed_at.timestamp())
        want.add((born, "created", born, None))
        want |= {(born, m, int(r[f"{m}_at"].timestamp()), None) for m in D.MARKS if r[f"{m}_at"]}
        if r.end_reason != "data ended":
            want.add((born, "ended", int(r.end_at.timestamp()), r.end_reason))
    return want


def test_gap_marks_equal_batch_with_late_and_repeated_rows(spark, bars, tmp_path):
    rows = bars.orderBy("ts").select(*COLUMNS).collect()
    rng = random.Random(2)
    order = sorted(range(len(rows)), key=lambda i: i + rng.uniform(0, 9))  # up to nine minutes late
    sent = [rows[i] for i in order]
    batches = [sent[i : i + 37] for i in range(0, len(sent), 37)]
    for i in range(1, len(batches)):
        batches[i] = batches[i] + rng.sample(batches[i - 1], 5)  # sent again
    batches.append([rows[3], rows[9]])  # long past the watermark
    schema = bars.select(*COLUMNS).schema
    files([spark.createDataFrame(b, schema) for b in batches], tmp_path / "in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with K.rocksdb(spark):
        got = drain(K.gap_lifecycle(stream, 60), tmp_path).collect()
    seen = bars.filter(F.col("ts") <= bars.agg(F.max("ts")).first()[0] - F.expr("interval 10 minutes"))
    want = batch_marks(seen)
    assert {(r.born, r.mark, r["at"], r.reason) for r in got} == want and len(got) == len(want)
    assert {m for _, m, _, _ in want} >= {"created", "entered", "partial", "half", "full", "validated", "invalidated", "ended"}
    assert {why for *_, why in want} >= {"invalidated", "suspect data", "contract roll"}


def test_gaps_end_with_age_and_day(spark, tmp_path):
    rows = [(100, 101, 99, 100.5), (101, 104, 101, 104), (104, 106, 103, 105)] + [(105, 106, 104, 105)] * 12
    b = minutes(spark, rows).unionByName(minutes(spark, [(100, 101, 99, 100.5), (100, 101, 99, 100.5), (101, 104, 101, 104), (104, 106, 103, 105), (105, 106, 104, 105)], start="2026-09-29 21:54:00")).unionByName(minutes(spark, [(1, 1, 1, 1)] * 20, start="2026-09-30 14:00:00"))
    prepared = B.prepare(b.select("symbol", "ts", "day", "contract", "open", "high", "low", "close", "volume", "suspect"), 60).withColumn("atr", F.lit(None).cast("double"))
    files([prepared.select(*COLUMNS)], tmp_path / "in")
    stream = spark.readStream.schema(prepared.select(*COLUMNS).schema).parquet(str(tmp_path / "in"))
    with K.rocksdb(spark):
        got = drain(K.gap_lifecycle(stream, 60, max_age=6), tmp_path).collect()
    seen = prepared.filter(F.col("ts") <= prepared.agg(F.max("ts")).first()[0] - F.expr("interval 10 minutes"))
    life = D.fvg_states(D.fvg(seen, 60), seen, 60, max_age=6).collect()
    assert {(int(r.confirmed_at.timestamp()), r.end_reason) for r in life if r.end_reason != "data ended"} == {(r.born, r.reason) for r in got if r.mark == "ended"}
    assert {r.reason for r in got if r.reason} == {"age limit", "session ended"}


def test_session_price_goes_on_after_a_restart(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    cut = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-10 03:20:00", "2024-01-20 15:40:00")]
    parts = [events.filter(F.col("ts") < cut[0]), events.filter((F.col("ts") >= cut[0]) & (F.col("ts") < cut[1])), events.filter(F.col("ts") >= cut[1])]
    with K.rocksdb(spark):
        for i, part in enumerate(parts):  # the query ends and starts again from its checkpoint
            part.coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
            stream = K.session_vwap(S.read_ticks(spark, str(tmp_path / "in"), "*.parquet"))
            got = drain(stream, tmp_path)
    t = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))
    b = B.bars_from_ticks(t, 3600).withColumn("day", cal.trading_day(F.col("ts"))).withColumn("suspect", F.lit(False))
    want = B.session_vwap(b).filter(F.col("ts") + F.expr("interval 1 hour") <= t.agg(F.max("ts")).first()[0] - F.expr("interval 10 minutes"))
    tidy = lambda df: sorted((r.symbol, r.ts, r.day, round(r.vwap, 6)) for r in df.select("symbol", "ts", "day", "vwap").collect())
    assert tidy(got) == tidy(want) and got.count() > 500
