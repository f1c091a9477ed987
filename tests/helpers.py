import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import bars as B


def daily(spark, closes, symbol="S", volume=1000.0):
    """Weekday bars from 2020-01-06 with open = high = low = close."""
    d, rows = dt.date(2020, 1, 6), []
    for c in closes:
        while d.weekday() >= 5:
            d += dt.timedelta(days=1)
        rows.append((symbol, d, float(c), float(c), float(c), float(c), volume))
        d += dt.timedelta(days=1)
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def minutes(spark, rows, start="2026-09-29 14:00:00", symbol="S", step=60, suspect=()):
    """(open, high, low, close) per step from a Tuesday morning, prepared for the detectors."""
    t0 = dt.datetime.fromisoformat(start)
    data = [(symbol, t0 + dt.timedelta(seconds=i * step), *map(float, r), 10.0, i in suspect, "C") for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, suspect boolean, contract string")
    return B.prepare(df.withColumn("day", cal.trading_day(F.col("ts"))), step)


def random_bars(n, seed=7, start=100.0):
    rng, p, out = random.Random(seed), start, []
    for _ in range(n):
        o = p
        c = round(o + rng.gauss(0, 0.5), 2)
        h, l = round(max(o, c) + abs(rng.gauss(0, 0.2)), 2), round(min(o, c) - abs(rng.gauss(0, 0.2)), 2)
        out.append((o, h, l, c))
        p = c
    return out
