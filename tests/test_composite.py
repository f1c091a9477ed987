"""The assembled series: identification, roll rule, filling, disagreement, provenance."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import composite as K

D1, D2, D3 = dt.date(2026, 9, 29), dt.date(2026, 9, 30), dt.date(2026, 10, 1)
COLUMNS = "root string, ts timestamp, open double, high double, low double, close double, volume double"


def candles(day, base, volume=100.0, n=30, changes=None, leave_out=()):
    """Minutes from 09:30 in New York."""
    start = dt.datetime.combine(day, dt.time(13, 30))
    out = []
    for i in range(n):
        if i not in leave_out:
            c = base + i * 0.25 + (changes or {}).get(i, 0)
            out.append(("NQ", start + dt.timedelta(minutes=i), c - 1, c + 2, c - 2, c, float(volume)))
    return out


@pytest.fixture
def made(spark):
    def run(cont, contracts, sample=(), minimum=20):
        plain = lambda rows: spark.createDataFrame(list(rows), COLUMNS).withColumn("day", cal.trading_day(F.col("ts")))
        labelled = [(*r, f"K{rank}", rank) for rank, rows in contracts.items() for r in rows]
        k = spark.createDataFrame(labelled, COLUMNS + ", contract string, rank long").withColumn("day", cal.trading_day(F.col("ts")))
        return K.assemble(plain(cont), k, plain(sample), minimum=minimum)

    return run


def test_identification_roll_and_provenance(made):
    z1, z2 = candles(D1, 20300, 5), candles(D2, 20400, 100)
    got = made(candles(D1, 20000) + z2, {1: z1 + z2})
    by_day = {d: {r.contract for r in got.candles.collect() if r.day == d} for d in (D1, D2)}
    assert by_day == {D1: {None}, D2: {"K1"}}
    rolls = got.rolls.collect()
    assert [(r.day, r.from_contract, r.contract, r.volume, r.from_volume) for r in rolls] == [(D2, None, "K1", 3000.0, 0.0)]
    s = sorted(got.segments.collect(), key=lambda r: r.from_day)
    assert [(r.contract, r.source, r.bars, r.verified_days) for r in s] == [(None, "continuous", 30, 0), ("K1", "contract:K1", 30, 1)]


def test_never_rolls_backwards(made):
    z = candles(D1, 20300) + candles(D2, 20300, 50) + candles(D3, 20300, 900)
    h = candles(D2, 20500, 500) + candles(D3, 20500, 10)
    got = made([], {1: z, 2: h})
    assert [(r.day, r.contract) for r in got.rolls.collect()] == [(D2, "K2")]
    assert {r.contract for r in got.candles.collect() if r.day == D3} == {"K2"}


def test_a_matching_sample_fills_and_marks(made):
    z = candles(D1, 20300, leave_out={10})
    got = made([], {1: z}, candles(D1, 20300, changes={20: 5}))
    rows = got.candles.collect()
    assert len(rows) == 30
    assert [(r.source, r.contract) for r in rows if r.source == "sample"] == [("sample", "K1")]
    assert [r.disagrees for r in rows if r.disagrees] == ["sample"]
    s = got.segments.first()
    assert (s.bars, s.filled, s.verified_days) == (30, 1, 1)


def test_a_sample_of_another_contract_is_not_spliced(made):
    got = made([], {1: candles(D1, 20300, leave_out={5})}, candles(D1, 20000))
    assert got.candles.count() == 29 and got.days.first().sample == "another"
    few = made([], {1: candles(D1, 20300, n=10, leave_out={5})}, candles(D1, 20300, n=10))
    assert few.candles.count() == 9 and few.days.first().sample == "unknown"


def test_odd_candles_of_an_identified_day_are_noise(made):
    z = candles(D1, 20300)
    got = made(candles(D1, 20300, changes={3: 2.5}), {1: z})
    rows = got.candles.collect()
    assert {r.contract for r in rows} == {"K1"} and [r.disagrees for r in rows if r.disagrees] == ["continuous"]
    half = made(candles(D1, 20300, volume=900, changes={i: 50 for i in range(15)}), {1: candles(D1, 20300)})
    assert half.days.first().source == "continuous" and half.candles.count() == 15


def test_empty_inputs(made, spark):
    assert made([], {}).candles.count() == 0
    assert made(candles(D1, 20000), {}).candles.count() == 30
    assert made([], {}, candles(D1, 20000)).candles.count() == 0
