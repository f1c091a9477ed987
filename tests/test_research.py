"""Indicators, conditions, episodes and statistics on small known series."""

import math
import statistics

import pytest
from helpers import daily
from pyspark.sql import functions as F

from tidemark.operators import conditions as C
from tidemark.operators import daily_quality as Q
from tidemark.operators import episodes as E
from tidemark.operators import indicators as I
from tidemark.operators import risk as K
from tidemark.operators import robust as R

FALL = {"c": ("price_move", {"direction": "falls", "threshold": 5, "window": 1})}


def _eps(spark, closes, horizon):
    d = C.evaluate(daily(spark, closes), FALL)
    return E.episodes(d, C.combine("c"), horizon, 1).filter("i is not null").orderBy("i").collect()


def test_drop_and_recover(spark):
    e = _eps(spark, [100.0] * 30 + [90.0] * 10 + [105.0] * 40, 10)
    assert len(e) == 1 and e[0].status == "complete" and e[0].close == 90
    assert e[0].forward_return == pytest.approx(105 / 90 - 1)


def test_episodes_never_overlap(spark):
    e = _eps(spark, [100 * 0.94 ** (i % 3) for i in range(200)], 7)
    starts = [x.i for x in e]
    assert len(starts) > 10 and all(b - a >= 8 for a, b in zip(starts, starts[1:]))


def test_pending_tail(spark):
    e = _eps(spark, [100.0] * 60 + [90.0] * 3, 10)
    assert [x.status for x in e] == ["pending"] and e[0].forward_return is None


def test_no_look_ahead(spark):
    a = [100 + 10 * math.sin(i / 3) for i in range(90)]
    b = a[:45] + [3 * x for x in a[45:]]
    ids = {"m": ("price_move", {"threshold": 2, "window": 5}), "d": ("drawdown_from_high", {"threshold": 5, "lookback": 20}), "r": ("rsi", {"period": 5}), "x": ("ma_cross", {"period": 10}), "n": ("new_extreme", {"lookback": 20})}
    rows = [[tuple(r) for r in C.evaluate(daily(spark, s), ids).filter("i < 45").orderBy("i").select(*ids).collect()] for s in (a, b)]
    assert rows[0] == rows[1]


def test_symbol_independence(spark):
    one, two = daily(spark, [100 + i % 7 for i in range(60)], "A"), daily(spark, [50 - i % 5 for i in range(60)], "B")
    alone = [r.v for r in I.numbered(one).withColumn("v", I.sma(5)).orderBy("i").collect()]
    both = [r.v for r in I.numbered(one.unionByName(two)).withColumn("v", I.sma(5)).filter("symbol = 'A'").orderBy("i").collect()]
    assert alone == both


def test_rsi_wilder(spark):
    closes = [44.0, 44.3, 44.1, 44.5, 43.9, 44.6, 45.0, 44.8, 45.2, 45.1]
    got = [r.rsi for r in I.with_rsi(I.numbered(daily(spark, closes)), 3).orderBy("i").collect()]
    ch = [b - a for a, b in zip(closes, closes[1:])]
    g, l = sum(max(x, 0) for x in ch[:3]) / 3, sum(max(-x, 0) for x in ch[:3]) / 3
    want = [None] * 3 + [100 - 100 / (1 + g / l)]
    for x in ch[3:]:
        g, l = (g * 2 + max(x, 0)) / 3, (l * 2 + max(-x, 0)) / 3
        want.append(100 - 100 / (1 + g / l))
    assert got[:3] == want[:3] and got[3:] == pytest.approx(want[3:])
    flat = [r.rsi for r in I.with_rsi(I.numbered(daily(spark, [1.0, 2, 3, 4, 5])), 3).orderBy("i").collect()]
    assert flat[3:] == [100.0, 100.0]


def _values(spark, vs):
    return spark.createDataFrame([("S", i, float(v)) for i, v in enumerate(vs)], "symbol string, i long, v double")


@pytest.mark.parametrize("n", [1, 4, 5, 9, 10, 31])
def test_robust(spark, n):
    vs = [(-1) ** i * (i + 1) / 50 for i in range(n)]
    df = _values(spark, vs)
    s = R.summarize(df, ["symbol"]).first()
    assert s.n == n and s["median"] == pytest.approx(statistics.median(vs)) and s["mean"] == pytest.approx(statistics.fmean(vs))
    assert (s.t_crit is None) == (n < 2)
    k = max(int(n * 0.05), 1 if n >= 10 else 0)
    t, w = R.trimmed_mean(df, ["symbol"]).first(), R.winsorized_mean(df, ["symbol"]).first()
    o = sorted(vs)
    if k and n - 2 * k >= 2:
        assert t.trimmed_mean == pytest.approx(statistics.fmean(o[k:n - k])) and t.each_side == k
        assert w.winsorized_mean == pytest.approx(statistics.fmean([min(max(v, o[k]), o[n - k - 1]) for v in vs]))
    else:
        assert t.trimmed_mean is None and t.each_side == 0
    b = R.bootstrap_ci(df, ["symbol"], "i", samples=200).collect()
    if n < 5:
        assert b == []
    else:
        assert b[0].mean_low <= s["mean"] <= b[0].mean_high
        assert b == R.bootstrap_ci(df, ["symbol"], "i", samples=200).collect()


def test_t_table(spark):
    got = {r.d: r.t for r in spark.createDataFrame([(d,) for d in (1, 30, 35, 120, 121)], "d int").select("d", R.t_critical(F.col("d")).alias("t")).collect()}
    assert got[1] == 12.706 and got[30] == 2.042 and got[120] == 1.980 and got[121] == 1.960
    assert got[35] == pytest.approx(2.021 + (1 / 35 - 1 / 40) / (1 / 30 - 1 / 40) * (2.042 - 2.021))


def test_split_bad_print_real_move(spark):
    d = daily(spark, [400.0] * 10 + [100.0] * 10)
    day = d.orderBy("date").collect()[10].date
    sp = spark.createDataFrame([("S", day, 4.0)], "symbol string, date date, ratio double")
    out = Q.adjust(Q.classify_moves(d, sp)).orderBy("date").collect()
    assert out[9].close == pytest.approx(100) and out[9].volume == pytest.approx(4000)
    none = spark.createDataFrame([], "symbol string, date date, ratio double")
    c = Q.classify_moves(daily(spark, [100.0] * 5 + [10.0] + [100.0] * 5 + [160.0] * 5), none)
    assert [(r.close, r.check) for r in c.filter("check is not null").orderBy("date").collect()] == [(10.0, "spike_and_revert"), (160.0, "extreme_move")]
    assert 10.0 not in [r.close for r in Q.adjust(c).collect()]


def test_drawdown_recovers_at_equal_price(spark):
    d = K.drawdowns(daily(spark, [100.0, 90, 80, 95, 100, 99, 120, 60]), -0.05).orderBy("peak").collect()
    assert [(round(x.depth, 2), x.days_to_trough, x.days_to_recover) for x in d] == [(-0.2, 2, 2), (-0.5, 1, None)]


def test_peer_median(spark):
    df = spark.createDataFrame([("a", 0.02), ("b", -0.03), ("c", 0.05), ("d", 0.011)], "symbol string, move double").withColumn("g", F.lit(1))
    got = {r.symbol: (round(r.peer_median, 6), r.same_direction) for r in K.peer_moves(df, ["g"]).collect()}
    assert got == {"a": (0.011, 2), "b": (0.02, 0), "c": (0.011, 2), "d": (0.02, 2)}
