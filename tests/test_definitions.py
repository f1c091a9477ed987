"""Definitions: bounds, dispatch, storage, tables of them; the detectors' optional rules against a bar-by-bar reading."""

import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import daily, minutes, random_bars
from tidemark.operators import conditions as C
from tidemark.operators import definitions as N
from tidemark.operators import detectors as D


@pytest.fixture(scope="module")
def market(spark):
    bars = minutes(spark, random_bars(600, 5), suspect={50, 51, 300}).withColumn("volume", F.when(F.col("bar_no") % 7 == 0, 0.0).otherwise(10.0 + F.col("bar_no") % 13))
    return N.Market(bars, 60, 0.25, levels=None)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize(
    ("name", "params", "message"),
    [
        ("price_move", {"threshold": 500}, "price_move: threshold must be between 0.5 and 95"), ("rsi", {"op": "beyond"}, "rsi: op must be one of below, above"), ("rsi", {"level": "x"}, "rsi: level must be a number"),
        ("displacement", {"consecutive": 11}, "displacement: consecutive must be between 1 and 10"), ("candle", {"engulfing": "maybe"}, "candle: engulfing must be true or false"), ("nothing", {}, "unknown concept: nothing"),
    ],
)
def test_out_of_bounds_values_are_refused_by_name(name, params, message):
    with pytest.raises(N.DefinitionError, match=message.replace(".", r"\.")):
        N.concept(name).checked(params)


def test_defaults_and_rounding():
    assert N.concept("price_move").checked({"window": 4.6, "unknown": 1}) == {"direction": "falls", "threshold": 5.0, "window": 5}
    assert set(N.CONDITIONS) == set(C.REGISTRY)
    for name, c in C.REGISTRY.items():
        assert set(N.CONCEPTS[name].params) == set(c.defaults)


CALLS = {
    "fvg": ({"min_gap": 0.1}, lambda m: D.fvg(m.with_atr(), m.step, min_gap=0.1)), "displacement": ({"atr_mult": 1.0}, lambda m: D.displacement(m.with_atr(), 60, atr_mult=1.0)),
    "market_structure_break": ({"swing_left": 2, "swing_right": 2}, lambda m: D.structure(m.with_atr(), D.swings(m.bars, 60, 2, 2), 60)), "candle": ({"min_range_atr": 1.2}, lambda m: D.candle_shape(m.with_atr(), 60, min_body=0, min_atr=1.2)),
    "directional_move": ({"lookback": 4}, lambda m: D.directional_move(m.with_atr(), 60, lookback=4)), "volume_spike": ({"multiple": 1.3}, lambda m: D.volume_spike(m.bars, 60, 1.3)),
    "volatility_expansion": ({}, lambda m: D.vol_expansion(m.with_atr(), 60)), "session_sweep": ({"side": "buy-side", "penetration_ticks": 1, "reclaim_bars": 9, "warmup": 5}, lambda m: D.session_sweeps(m.bars, 60, 0.25, False, 1, 9, 5)), "vwap": ({"anchor": "globex"}, lambda m: D.vwap_cross(m.vwap("globex"), 60)),
}


@pytest.mark.parametrize("name", CALLS)
def test_a_definition_equals_the_direct_call(market, name):
    params, call = CALLS[name]
    want = rows(call(market), "symbol", "confirmed_at", "direction")
    got = rows(N.compile_definition(json.dumps({"concept": name, "params": params}), market), "symbol", "at", "direction")
    assert got == want and want
    up = N.compile_definition({"concept": name, "params": {**params, "direction": "bullish"}}, market)
    assert rows(up, "symbol", "at", "direction") == [r for r in want if r[2] == "bullish"]


def test_conditions_and_logic(spark):
    bars = daily(spark, [100 + (i * 7) % 11 for i in range(80)])
    body = {"conditions": [{"id": "a", "type": "price_move", "params": {"threshold": 3, "window": 1}}, {"type": "ma_position", "params": {"period": 5, "op": "below"}}]}
    got = rows(N.compile_definition(body, daily=bars), "symbol", "at")
    both = C.evaluate(bars, {"a": ("price_move", {"threshold": 3, "window": 1}), "c2": ("ma_position", {"period": 5, "op": "below"})}).filter("a and c2")
    assert got == rows(both.withColumn("at", F.col("date").cast("timestamp")), "symbol", "at") and got
    with pytest.raises(N.DefinitionError, match="logic"):
        N.compile_definition({**body, "logic": {"op": "AND", "items": ["a"]}}, daily=bars)
    with pytest.raises(N.DefinitionError, match="daily bars"):
        N.compile_definition(body)


def test_saved_definitions(spark, tmp_path, market):
    saved = N.Definitions(spark, str(tmp_path / "defs"))
    assert saved.all().count() == 0 and saved.params("displacement")["atr_mult"] == 1.5
    saved.save("Mine", {"concept": "displacement", "params": {"atr_mult": 2}}, auto=True)
    saved.save("Other", {"concept": "displacement", "params": {"atr_mult": 1}}, auto=True)
    saved.save("mine", {"concept": "displacement", "params": {"atr_mult": 3}})
    assert {(r.name, r.auto) for r in saved.all().collect()} == {("mine", False), ("Other", True)}
    assert saved.params("displacement")["atr_mult"] == 1.0
    with pytest.raises(N.DefinitionError, match="atr_mult must be between"):
        saved.save("bad", {"concept": "displacement", "params": {"atr_mult": 99}})
    got = saved.compiled(["OTHER"], market)
    assert rows(got, "name", "symbol", "at") == [("Other", *r) for r in rows(N.compile_definition({"concept": "displacement", "params": {"atr_mult": 1}}, market), "symbol", "at")]
    saved.delete("Other")
    assert [r.name for r in saved.all().collect()] == ["mine"]
    with pytest.raises(N.DefinitionError, match="no definition named Other"):
        saved.compiled(["Other"], market)


def test_a_table_of_definitions_is_checked_like_one(spark):
    rng = random.Random(3)
    values = [0, 1, 2.5, 7, 60, 500, -3, "x", "falls", "above", True]
    given = [("none", "gone", {})]
    for i in range(120):
        c = rng.choice(list(N.CONCEPTS.values()))
        given.append((f"d{i}", c.name, {n: (rng.choice(values) if rng.random() < 0.3 else s.default) for n, s in c.params.items() if rng.random() < 0.7}))
    table = spark.createDataFrame([(n, json.dumps({"concept": c, "params": p})) for n, c, p in given], "name string, body string")
    found = {r.name: r for r in N.check_table(table).collect()}
    assert len(found) == len(given)
    for name, concept, params in given:
        try:
            clean, problem = N.concept(concept).checked(json.loads(json.dumps(params))), None
        except N.DefinitionError as e:
            clean, problem = None, str(e)
        assert found[name].problem == problem, (concept, params)
        assert clean is None or {k: float(v) for k, v in found[name].params.items() if N.concept(concept).params[k].kind in ("number", "int")} == {k: float(v) for k, v in clean.items() if N.concept(concept).params[k].kind in ("number", "int")}
    bad = spark.createDataFrame([("null", None), ("empty", "{}"), ("no json", "{")], "name string, body string")
    assert {r.name: r.problem for r in N.check_table(bad).collect()} == dict.fromkeys(["null", "empty", "no json"], "unknown concept: None")


def test_displacement_waits_for_its_gap(market):
    """Every rule bar by bar, with a gap behind the last candle known one candle later."""
    p = dict(consecutive=2, atr_mult=0.7, min_body=0.3, close_pct=60, volume_mult=0.9, volume_lookback=6)
    b = [r.asDict() for r in market.with_atr().orderBy("bar_no").collect()]
    joined = lambda a, z: a >= 0 and z < len(b) and len({(b[i]["day"], b[i]["run"]) for i in range(a, z + 1)}) == 1 and not any(b[i]["suspect"] for i in range(a, z + 1))
    for gap in (False, True):
        want, last = [], -1
        for i in range(1, len(b)):
            a = i - 1
            if a <= last or not joined(a, i) or b[a]["atr_before"] is None:
                continue
            up, down = all(b[j]["close"] > b[j]["open"] for j in (a, i)), all(b[j]["close"] < b[j]["open"] for j in (a, i))
            hi, lo = max(b[a]["high"], b[i]["high"]), min(b[a]["low"], b[i]["low"])
            before = [b[j]["volume"] for j in range(max(0, a - 6), a) if b[j]["volume"]]
            if not (up or down) or hi - lo <= 0 or hi - lo < 0.7 * b[a]["atr_before"] or abs(b[i]["close"] - b[a]["open"]) < 0.3 * (hi - lo) or (hi - b[i]["close"] if up else b[i]["close"] - lo) > 0.6 * (hi - lo):
                continue
            if len(before) < 3 or b[a]["volume"] + b[i]["volume"] < 0.9 * sum(before) / len(before) * 2:
                continue
            end = i
            if gap:
                if not joined(a - 1, i + 1):
                    continue
                left = lambda c: b[c - 1]["high"] < b[c + 1]["low"] if up else b[c - 1]["low"] > b[c + 1]["high"]
                middle = next((c for c in (a, i) if left(c)), None)
                if middle is None:
                    continue
                end = max(middle + 1, i)
            want.append((b[a]["ts"], b[end]["ts"], "bullish" if up else "bearish"))
            last = i
        got = D.displacement(market.with_atr(), 60, require_gap=gap, **p).select("occurred_at", (F.col("confirmed_at") - F.expr("interval 60 seconds")).alias("c"), "direction").collect()
        assert sorted(tuple(r) for r in got) == want and want


@pytest.mark.parametrize("by", ["close", "wick"])
def test_structure_by_close_and_by_wick(market, by):
    """Swing pools walked bar by bar."""
    sw = sorted((r.asDict() for r in D.swings(market.bars, 60, 2, 2).collect()), key=lambda s: s["confirmed_at"])
    b = [r.asDict() for r in market.bars.orderBy("bar_no").collect()]
    pools, trend, regime, at, want = {"bullish": [], "bearish": []}, None, None, 0, []
    for bar in b:
        if bar["regime"] != regime:
            regime, trend, pools = bar["regime"], None, {"bullish": [], "bearish": []}
        while at < len(sw) and sw[at]["confirmed_at"] <= bar["ts"]:
            if sw[at]["regime"] == regime:
                pools["bullish" if sw[at]["kind"] == "swingh" else "bearish"].append(sw[at])
            at += 1
        for side, sign in (("bullish", 1), ("bearish", -1)):
            pool = [s for s in pools[side] if bar["bar_no"] - s["bar_no"] <= 200]
            price = bar["close"] if by == "close" else bar["high" if sign > 0 else "low"]
            if not bar["suspect"] and pool:
                newest = max(pool, key=lambda s: s["bar_no"])
                if sign * (price - newest["price"]) > 0:
                    want.append((bar["ts"], side, newest["price"], "break" if trend is None else "BOS" if trend == side else "against"))
                    trend = side
                    pool = [s for s in pool if sign * (s["price"] - price) >= 0]
            pools[side] = pool
    e = N.events(market, "market_structure_break", {"by": by, "swing_left": 2, "swing_right": 2}).collect()
    got = sorted((r.occurred_at, r.direction, r.level, {"CHoCH": "against", "MSS": "against"}.get(r.type, r.type)) for r in e)
    assert got == sorted(want) and len(got) > 10
    kept = N.events(market, "market_structure_break", {"by": by, "type": "mss", "swing_left": 2, "swing_right": 2}).collect()
    assert {r.occurred_at for r in kept} == {r.occurred_at for r in e if r.type == "MSS"}
