"""Detectors against hand-made candles and step-by-step loops."""

import datetime as dt

import pytest
from helpers import minutes, random_bars
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import bars as B
from tidemark.operators import detectors as D
from tidemark.operators import episodes as E
from tidemark.operators import setups as P


def test_trading_day_and_dst(spark):
    cases = {  # UTC instant -> trading day
        "2026-03-06 22:30:00": "2026-03-06",  # Friday 17:30 New York
        "2026-03-06 23:30:00": "2026-03-09",  # Friday 18:30
        "2026-03-08 21:30:00": "2026-03-09",  # Sunday 17:30 after the clocks changed
        "2026-03-09 21:59:59": "2026-03-09", "2026-03-09 22:00:00": "2026-03-10", "2026-11-02 22:59:59": "2026-11-02", "2026-11-02 23:00:00": "2026-11-03",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.t: str(r.d) for r in df.select("t", cal.trading_day(F.col("ts")).alias("d")).collect()}
    assert got == cases
    opens = df.select(cal.market_open(F.col("ts")).alias("o"), "t").collect()
    assert {r.t: r.o for r in opens}["2026-03-06 22:30:00"] is False


GAP = [(100, 101, 99, 100), (100, 104, 100, 104), (104, 105, 102, 104), (104, 104.5, 101.5, 103), (103, 104, 100.5, 103.5), (103.5, 106, 103, 105.5)]


def test_gap_life(spark):
    b = minutes(spark, GAP).withColumn("atr", F.lit(None).cast("double"))
    g = D.fvg(b, 60)
    row = g.filter("direction = 'bullish'").orderBy("confirmed_at").first()
    assert (row.bottom, row.top) == (101.0, 102.0)
    life = D.fvg_states(g.filter("bottom = 101"), b, 60).first()
    assert life.entered_at == life.partial_at == life.half_at == dt.datetime(2026, 9, 29, 14, 4)
    assert life.full_at == dt.datetime(2026, 9, 29, 14, 5) and life.validated_at is not None and life.invalidated_at is None and life.end_reason == "data ended"


def test_suspect_never_creates(spark):
    b = minutes(spark, GAP, suspect={1}).withColumn("atr", F.lit(None).cast("double"))
    assert D.fvg(b, 60).filter("bottom = 101").count() == 0


@pytest.fixture(scope="module")
def walk(spark):
    rows = random_bars(700)
    return rows, minutes(spark, rows, start="2026-09-28 22:00:00", suspect={50, 51, 333})


def test_swings_loop(spark, walk):
    rows, b = walk
    got = {(r.kind, r.bar_no) for r in D.swings(b, 60).collect()}
    want = set()
    for i in range(3, len(rows) - 3):
        win = range(i - 3, i + 4)
        if any(k in (50, 51, 333) for k in win):
            continue
        if all(rows[i][1] > rows[k][1] for k in win if k != i):
            want.add(("swingh", i))
        if all(rows[i][2] < rows[k][2] for k in win if k != i):
            want.add(("swingl", i))
    assert got == want and want


def test_structure_matches_the_sequential_reading(spark, walk):
    """The set-based breaks equal a bar-by-bar reading that keeps the unbroken swings and the trend."""
    rows, b = walk
    bars = D.with_atr_before(b)
    sw = D.swings(b, 60)
    got = [(r.bar_no, r.direction, r.type, r.level) for r in D.structure(bars, sw, 60, max_age=60).orderBy("bar_no", F.desc("direction")).collect()]
    points = sorted(((r.bar_no, r.kind, r.price) for r in sw.collect()), key=lambda p: p[0])
    before = {r.bar_no: r.atr_before for r in bars.collect()}
    pools, trend, want = {"bullish": [], "bearish": []}, None, []
    for j, (o, h, l, c) in enumerate(rows):
        for n, kind, price in points:
            if n + 4 == j:
                pools["bullish" if kind == "swingh" else "bearish"].append((n, price))
        for side in pools:
            pools[side] = [p for p in pools[side] if j - p[0] <= 60]
        if j in (50, 51, 333):
            continue
        for side, sign in (("bullish", 1), ("bearish", -1)):
            if not pools[side]:
                continue
            n, price = max(pools[side])
            if sign * (c - price) > 0:
                big = before[j] is not None and h > l and h - l >= before[j] and abs(c - o) >= 0.5 * (h - l)
                want.append((j, side, "break" if trend is None else "BOS" if trend == side else "MSS" if big else "CHoCH", price))
                trend = side
                pools[side] = [p for p in pools[side] if sign * (c - p[1]) <= 0]
    assert len(want) > 20 and sorted(got) == sorted(want)


def test_displacement_runs_do_not_overlap(spark, walk):
    rows, b = walk
    got = sorted(r.bar_no for r in D.displacement(D.with_atr_before(b), 60, consecutive=2, atr_mult=1.0, min_body=0.3, close_pct=60).collect())
    assert len(got) > 5 and all(y - x >= 2 for x, y in zip(got, got[1:]))


def test_greedy_spaced(spark):
    df = spark.createDataFrame([("a", i) for i in (0, 1, 2, 3, 4, 10, 12, 13)], "k string, i long")
    assert sorted(r.i for r in E.greedy_spaced(df, ["k"], "i", 3).collect()) == [0, 3, 10, 13]


@pytest.mark.parametrize("cut", [200, 411])
def test_no_look_ahead(spark, walk, cut):
    """Cut the future: whatever was confirmed by then stays the same."""
    rows, full = walk
    part = minutes(spark, rows[:cut], start="2026-09-28 22:00:00", suspect={50, 51, 333})
    limit = dt.datetime(2026, 9, 28, 22) + dt.timedelta(minutes=cut)

    def known(b):
        a = D.with_atr_before(b)
        parts = [D.fvg(a, 60), D.displacement(a, 60), D.candle_shape(b, 60), D.directional_move(a, 60), D.volume_spike(b, 60), D.vol_expansion(a, 60), D.structure(a, D.swings(b, 60), 60), D.vwap_cross(B.session_vwap(b), 60)]
        e = D.union_events(parts).select("concept", "direction", "occurred_at", "confirmed_at")
        return sorted(tuple(r) for r in e.collect() if r.confirmed_at <= limit)

    a, b = known(full), known(part)
    assert a == b and len(a) > 30


def test_sweep_and_reclaim(spark):
    rows = [(100, 101, 99, 100)] * 3 + [(100, 100.5, 97.5, 98.5), (98.5, 100, 98, 99.5), (99.5, 100, 99, 99.8)]
    b = minutes(spark, rows)
    t = dt.datetime(2026, 9, 29, 14, 1)
    lv = spark.createDataFrame([("S", "pdl", 98.6, t, t + dt.timedelta(hours=3))], "symbol string, kind string, price double, available_from timestamp, valid_until timestamp")
    e = D.sweeps(lv, b, 60, 0.25).collect()
    assert len(e) == 1 and e[0].direction == "bullish" and e[0].extreme == 97.5 and e[0].confirmed_at == dt.datetime(2026, 9, 29, 14, 5)


def test_stop_wins_the_tie_and_gaps_fill_at_the_open(spark):
    rows = [(100, 100, 100, 100), (100, 103, 97, 100), (96, 97, 95, 96)]
    b = minutes(spark, rows)
    s = b.filter("bar_no = 0").select("symbol", "bar_no", D.close_time(60).alias("t"), F.lit("bullish").alias("direction"), F.col("close").alias("entry"), F.lit(2.0).alias("atr"))
    tie = P.barrier_outcomes(s, b, 60, [(1.0, 1.0)], 5).first()
    assert tie.reason == "stop" and tie.ambiguous and tie["exit"] == 98.0 and tie.r_gross == -1.0
    gap = P.barrier_outcomes(s, minutes(spark, [rows[0], (100, 100.5, 99, 100), rows[2]]), 60, [(1.0, 2.0)], 5).first()
    assert gap.reason == "stop" and gap["exit"] == 96.0


def test_setups_without_an_exit_stay_open(spark):
    rows = [(100, 100, 100, 100), (100, 100.5, 99.5, 100), (100, 100.4, 99.6, 100)]
    b = minutes(spark, rows)
    s = b.select("symbol", "bar_no", D.close_time(60).alias("t"), F.lit("bullish").alias("direction"), F.col("close").alias("entry"), F.lit(2.0).alias("atr"))
    got = P.barrier_outcomes(s, b, 60, [(1.0, 1.0), (0.2, 9.0)], 5).collect()
    assert len(got) == 6  # every setup and pair, also the one on the last bar
    assert {(r.bar_no, r.stop_atr): r.reason for r in got} == {(0, 1.0): "open", (0, 0.2): "stop", (1, 1.0): "open", (1, 0.2): "stop", (2, 1.0): "open", (2, 0.2): "open"}
    assert all(r["exit"] is None and r.r_net is None and r.mfe_r is None and not r.suspect for r in got if r.reason == "open")
    m = P.trade_metrics(P.barrier_outcomes(s, b, 60, [(0.2, 9.0)], 5), ["symbol"]).first()
    assert (m.n, m.open_at_end, m.excluded_suspect) == (2, 1, 0)


def test_streaks_and_drawdown(spark):
    vals = [1, 1, -1, 0, 1, 1, 1, -2, -1, -1]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(vals)], "k string, t long, r_net double").withColumn("suspect", F.lit(False)).withColumn("chunk", F.floor(F.col("t") / 3))
    s = P.streaks(df, ["k"], ["t"], "chunk").first()
    assert (s.max_wins, s.max_losses) == (3, 3)
    assert P.cumulative_drawdown(df, ["k"], ["t"], "chunk").first().max_drawdown == -4.0
