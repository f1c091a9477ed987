"""Event detectors on prepared candles.  Occurred at a bar's open, confirmed at a bar's close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import bars as B
from tidemark.operators import ordered as O


def in_day():
    return Window.partitionBy("symbol", "day").orderBy("ts")


def contiguous(back: int) -> Column:
    """This bar and the ``back`` bars before it are consecutive, clean and in one day and regime."""
    w = in_day()
    return ~F.col("suspect") & F.coalesce(F.lag("run", back).over(w) == F.col("run"), F.lit(False)) & ~F.coalesce(F.lag("suspect", back).over(w), F.lit(False))


def close_time(step: int) -> Column:
    return F.col("ts") + B.seconds_interval(step)


def event(concept: str, direction: Column, occurred: Column, confirmed: Column, *extra: Column) -> list[Column]:
    """The common event prefix followed by what the detector adds."""
    return [F.col("symbol"), F.lit(concept).alias("concept"), direction.alias("direction"), occurred.alias("occurred_at"), confirmed.alias("confirmed_at"), F.col("day"), *extra]


def up_or_down(up: Column) -> Column:
    return F.when(up, "bullish").otherwise("bearish")


# --- fair value gaps -----------------------------------------------------------------------------------

def fvg(bars: DataFrame, step: int, min_gap: float = 0.0, unit: str = "points", tick: float = 0.25, displacement: float | None = None,
        min_body: float = 0.6) -> DataFrame:
    """Three consecutive clean candles of one day leaving a gap; ``bars`` carries ``atr``."""
    w = in_day()
    lag = lambda c, n: F.lag(c, n).over(w)
    x = bars.withColumns({
        "h1": lag("high", 2), "l1": lag("low", 2), "t1": lag("ts", 2), "c2": lag("close", 1), "o2": lag("open", 1), "h2": lag("high", 1), "l2": lag("low", 1),
        "atr2": lag("atr", 1), "atr1": lag("atr", 2), "_dirty": F.col("suspect") | F.col("after_gap") | lag("suspect", 1) | lag("after_gap", 1) | lag("suspect", 2) | lag("after_gap", 2),
    })
    bull, bear = F.col("h1") < F.col("low"), F.col("l1") > F.col("high")
    x = x.filter((F.unix_seconds("ts") - F.unix_seconds("t1") == 2 * step) & (bull | bear) & ~F.col("_dirty"))
    x = x.withColumns({"direction": up_or_down(bull), "top": F.when(bull, F.col("low")).otherwise(F.col("l1")), "bottom": F.when(bull, F.col("h1")).otherwise(F.col("high"))})
    x = x.withColumn("size", F.col("top") - F.col("bottom"))
    if min_gap:
        need = {"points": F.lit(min_gap), "ticks": F.lit(min_gap * tick), "percent": F.col("c2") * min_gap / 100, "ATR": F.col("atr2") * min_gap}[unit]
        x = x.filter(F.col("size") >= need)
    if displacement is not None:
        rng, body = F.col("h2") - F.col("l2"), F.abs(F.col("c2") - F.col("o2"))
        x = x.filter((rng > 0) & (F.try_divide(body, rng) >= min_body) & (rng >= displacement * F.col("atr1")))
    return x.select(*event("fvg", F.col("direction"), F.col("t1"), close_time(step), F.col("top"), F.col("bottom"), ((F.col("top") + F.col("bottom")) / 2).alias("mid"), F.col("size"), F.col("bar_no"), F.col("regime")))


MARKS = ["entered", "partial", "half", "full", "validated", "invalidated", "expired"]


def fvg_states(gaps: DataFrame, bars: DataFrame, step: int, max_age: int = 48, session_end: bool = True, validation: str = "close_beyond",
               invalidation: str = "close_beyond_far") -> DataFrame:
    """Life of each gap over at most ``max_age`` bars: first time of every mark, end and its reason.

    Bars reach a gap by equality on (symbol, position): each gap asks for its own next bars, so no
    range join and no group larger than ``max_age + 1``.
    """
    b = bars.select("symbol", F.col("bar_no").alias("_n"), F.struct("ts", F.col("day").alias("d"), F.col("regime").alias("r"), "suspect", "open", "high", "low", "close").alias("b"))
    x = gaps.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(max_age + 1)))).withColumn("_n", F.col("bar_no") + F.col("k"))
    x = x.join(b, ["symbol", "_n"], "left")
    keys = [c for c in gaps.columns]
    g = x.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("k", "b")))).alias("p"))
    bull = F.col("direction") == "bullish"

    def first(cond) -> Column:
        return F.array_min(F.transform(F.filter("p", cond), lambda e: e["k"]))

    out_of_day = (lambda e: e["b"]["d"] != F.col("day")) if session_end else (lambda e: F.lit(False))
    stops = lambda e: out_of_day(e) | (e["k"] > max_age) | (e["b"]["r"] != F.col("regime")) | e["b"]["suspect"]
    g = g.withColumn("stop_k", first(stops))
    g = g.withColumn("p", F.filter("p", lambda e: F.col("stop_k").isNull() | (e["k"] <= F.col("stop_k"))))
    stop = F.try_element_at(F.filter("p", lambda e: e["k"] == F.col("stop_k")), F.lit(1))
    reason = F.when(F.col("stop_k").isNotNull(), F.when(out_of_day(stop), "session ended").when(stop["k"] > max_age, "age limit").when(stop["b"]["r"] != F.col("regime"), "contract roll").otherwise("suspect data"))
    g = g.withColumn("reason", reason).withColumn("p", F.filter("p", lambda e: F.col("stop_k").isNull() | (e["k"] < F.col("stop_k"))))
    lo, hi, cl, op = (lambda e: e["b"]["low"]), (lambda e: e["b"]["high"]), (lambda e: e["b"]["close"]), (lambda e: e["b"]["open"])
    side = lambda a, b: (lambda e: F.when(bull, a(e)).otherwise(b(e)))
    far = {
        "close_beyond_far": side(lambda e: cl(e) < F.col("bottom"), lambda e: cl(e) > F.col("top")),
        "trade_beyond_far": side(lambda e: lo(e) < F.col("bottom"), lambda e: hi(e) > F.col("top")),
        "close_beyond_mid": side(lambda e: cl(e) < F.col("mid"), lambda e: cl(e) > F.col("mid")),
    }[invalidation]
    g = g.withColumn("invalidated_k", first(far))
    live = lambda cond: (lambda e: cond(e) & (F.col("invalidated_k").isNull() | (e["k"] <= F.col("invalidated_k"))))
    depth = lambda share: side(lambda e: (F.col("top") - lo(e)) / F.col("size") >= share, lambda e: (hi(e) - F.col("bottom")) / F.col("size") >= share)
    g = g.withColumns({
        "entered_k": first(live(side(lambda e: lo(e) <= F.col("top"), lambda e: hi(e) >= F.col("bottom")))),
        "partial_k": first(live(side(lambda e: lo(e) < F.col("top"), lambda e: hi(e) > F.col("bottom")))),
        "half_k": first(live(depth(0.5))), "full_k": first(live(depth(1.0))),
    })
    beyond = side(lambda e: cl(e) > F.col("top"), lambda e: cl(e) < F.col("bottom"))
    past_mid = side(lambda e: cl(e) < F.col("mid"), lambda e: cl(e) > F.col("mid"))
    g = g.withColumn("_mid_k", first(lambda e: past_mid(e) & (e["k"] >= F.col("entered_k"))))
    rule = {
        "close_beyond": beyond, "hold_midpoint": lambda e: beyond(e) & (F.col("_mid_k").isNull() | (e["k"] < F.col("_mid_k"))),
        "reaction_candle": lambda e: beyond(e) & F.when(bull, cl(e) > op(e)).otherwise(cl(e) < op(e)),
        "close_beyond_mid": side(lambda e: cl(e) > F.col("mid"), lambda e: cl(e) < F.col("mid")),
    }[validation]
    g = g.withColumn("validated_k", first(lambda e: rule(e) & (e["k"] >= F.col("entered_k")) & (F.col("invalidated_k").isNull() | (e["k"] < F.col("invalidated_k")))))
    at = lambda k: F.try_element_at(F.filter("p", lambda e: e["k"] == F.col(k)), F.lit(1))["b"]["ts"] + B.seconds_interval(step)
    last = F.coalesce(F.try_element_at(F.filter("p", lambda e: e["k"] == F.col("stop_k") - 1), F.lit(1))["b"]["ts"] + B.seconds_interval(step), F.col("confirmed_at"))
    ended_by_stop = F.col("invalidated_k").isNull() & F.col("stop_k").isNotNull()
    g = g.withColumns({f"{m}_at": at(f"{m}_k") for m in MARKS if m != "expired"})
    g = g.withColumn("expired_at", F.when(ended_by_stop & F.col("reason").isin("session ended", "age limit"), last))
    g = g.withColumn("end_at", F.when(F.col("invalidated_k").isNotNull(), F.col("invalidated_at")).when(F.col("stop_k").isNotNull(), last))
    g = g.withColumn("end_reason", F.when(F.col("invalidated_k").isNotNull(), "invalidated").otherwise(F.coalesce("reason", F.lit("data ended"))))
    named = F.array(*[F.struct(F.col(f"{m}_at").alias("at"), F.lit(i).alias("o"), F.lit(m).alias("name")) for i, m in enumerate(MARKS)])
    states = F.concat(F.array(F.struct(F.col("confirmed_at").alias("at"), F.lit(-1).alias("o"), F.lit("created").alias("name"))), F.sort_array(F.filter(named, lambda s: s["at"].isNotNull())))
    return g.select(*gaps.columns, *[f"{m}_at" for m in MARKS], "end_at", "end_reason", states.alias("states"))


def fvg_state_at(states: Column, end_at: Column, t: Column) -> Column:
    """Name of the last mark known at ``t``; ended once the end has passed without a final mark."""
    current = F.try_element_at(F.filter(states, lambda s: s["at"] <= t), F.lit(-1))["name"]
    known = F.exists(states, lambda s: s["at"] <= t)
    return F.when(~known, None).when(end_at.isNotNull() & (t >= end_at) & ~current.isin("invalidated", "expired"), "ended").otherwise(current)


# --- swings and levels ---------------------------------------------------------------------------------

def swings(bars: DataFrame, step: int, left: int = 3, right: int = 3) -> DataFrame:
    """Strict local extremes over left + right bars of one clean day and regime, known right bars later."""
    w = in_day()
    before, after, span = w.rowsBetween(-left, -1), w.rowsBetween(1, right), w.rowsBetween(-left, right)
    ok = (F.count(F.lit(1)).over(span) == left + right + 1) & ~F.bool_or("suspect").over(span) & (F.min("regime").over(span) == F.max("regime").over(span))
    x = bars.withColumns({
        "_ok": ok, "_hi": (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after)),
        "_lo": (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after)),
        "confirmed_at": F.lead("ts", right).over(w) + B.seconds_interval(step),
    }).filter("_ok and (_hi or _lo)")
    kinds = F.filter(F.array(F.when(F.col("_hi"), F.struct(F.lit("swingh").alias("kind"), F.col("high").alias("price"))), F.when(F.col("_lo"), F.struct(F.lit("swingl").alias("kind"), F.col("low").alias("price")))), lambda k: k.isNotNull())
    return x.select("symbol", F.explode(kinds).alias("k"), F.col("ts").alias("occurred_at"), "confirmed_at", "bar_no", "regime", "day").select(
        "symbol", "k.kind", "k.price", "occurred_at", "confirmed_at", "bar_no", "regime", "day")


def equal_levels(sw: DataFrame, tolerance: float, lookback: int = 50, touches: int = 2) -> DataFrame:
    """Swings of one kind within a price tolerance and a lookback; keyed by position block, so pairs stay local."""
    blk = F.floor(F.col("bar_no") / lookback)
    now = sw.withColumn("_b", F.explode(F.array(blk, blk - 1)))
    old = sw.select("symbol", "kind", blk.alias("_b"), F.col("bar_no").alias("q_no"), F.col("price").alias("q_price"), F.col("occurred_at").alias("q_at"))
    j = now.join(old, ["symbol", "kind", "_b"]).filter(
        (F.col("q_no") <= F.col("bar_no")) & (F.col("bar_no") - F.col("q_no") <= lookback) & (F.abs(F.col("q_price") - F.col("price")) <= tolerance + 1e-9))
    g = j.groupBy("symbol", "kind", "bar_no", "confirmed_at", "day", "regime").agg(
        F.count(F.lit(1)).alias("touches"), F.max("q_price").alias("_hi"), F.min("q_price").alias("_lo"), F.min("q_at").alias("occurred_at"))
    g = g.filter(F.col("touches") >= touches)
    high = F.col("kind") == "swingh"
    return g.select("symbol", F.when(high, "eqh").otherwise("eql").alias("kind"), F.when(high, F.col("_hi")).otherwise(F.col("_lo")).alias("price"), "occurred_at", "confirmed_at", "touches", "bar_no", "regime", "day")


SELL_SIDE = ["pdl", "onl", "sessl", "swingl", "eql", "pwl", "lonl", "asial", "nyaml"]  # fixed values


def swing_levels(sw: DataFrame) -> DataFrame:
    """A swing stays usable until the end of the next trading day."""
    d = cal.trading_day(F.col("confirmed_at"))
    end = B.at_clock(d, B.DAY_END_MINUTE) + F.when(F.dayofweek(d) == 6, F.expr("interval 72 hours")).otherwise(F.expr("interval 24 hours"))
    return sw.select("symbol", "kind", "price", F.col("confirmed_at").alias("available_from"), end.alias("valid_until"))


def sweeps(levels: DataFrame, bars: DataFrame, step: int, tick: float, pen_ticks: float = 2, max_ticks: float = 0, reclaim: int = 3) -> DataFrame:
    """First interaction with a level: beyond it by enough, then a close back through within ``reclaim`` bars."""
    pen, cap = pen_ticks * tick, max_ticks * tick
    hour = lambda c: F.date_trunc("day", c)
    lv = levels.withColumn("_id", F.struct("symbol", "kind", "price", "available_from"))
    closes = bars.withColumn("closed_at", close_time(step)).select("symbol", "closed_at", F.col("close").alias("prior_close"), F.col("bar_no").alias("prior_no"))
    regs = bars.select("symbol", F.col("ts").alias("open_at"), F.col("regime").alias("level_regime"))
    lv = O.asof_backward(lv, closes, ["symbol"], "available_from", "closed_at", ["prior_close", "prior_no"], hour)
    lv = O.asof_backward(lv, regs, ["symbol"], "available_from", "open_at", ["level_regime"], hour)
    sell = F.col("kind").isin(SELL_SIDE)
    through = F.when(sell, F.col("prior_close") <= F.col("price")).otherwise(F.col("prior_close") >= F.col("price"))
    lv = lv.filter(F.col("prior_no").isNotNull() & ~through)
    # Spread every level over the trading days of its validity: the join is an equality on (symbol, day).
    days = F.sequence(F.to_date(F.col("available_from") - B.seconds_interval(86400)), F.to_date(F.col("valid_until") + B.seconds_interval(86400)))
    spread = lv.withColumn("day", F.explode(days))
    b = bars.select("symbol", "day", "ts", "bar_no", F.col("regime").alias("b_regime"), "suspect", "high", "low")
    beyond = F.when(sell, F.col("low") <= F.col("price") - pen).otherwise(F.col("high") >= F.col("price") + pen)
    hit = spread.join(b, ["symbol", "day"]).filter(
        (F.col("bar_no") > F.col("prior_no")) & (close_time(step) <= F.col("valid_until")) & (F.col("b_regime") == F.col("level_regime")) & beyond)
    touch = hit.groupBy("symbol", "kind", "price", "available_from", "valid_until", "level_regime").agg(F.min_by(F.struct("bar_no", "ts"), "bar_no").alias("t"))
    touch = touch.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(reclaim - 1)))).withColumn("bar_no", F.col("t.bar_no") + F.col("k"))
    nxt = bars.select("symbol", "bar_no", F.struct("ts", "day", "regime", "suspect", "high", "low", "close").alias("b"))
    seq = touch.join(nxt, ["symbol", "bar_no"]).groupBy("symbol", "kind", "price", "available_from", "valid_until", "level_regime", "t").agg(
        F.sort_array(F.collect_list(F.struct("k", "b"))).alias("p"))
    reach = lambda e: F.when(sell, F.col("price") - e["b"]["low"]).otherwise(e["b"]["high"] - F.col("price"))
    bad = lambda e: e["b"]["suspect"] | (e["b"]["regime"] != F.col("level_regime")) | ((reach(e) > cap) if cap else F.lit(False))
    stop = F.array_min(F.transform(F.filter("p", bad), lambda e: e["k"]))
    seq = seq.withColumn("_stop", stop).withColumn("p", F.filter("p", lambda e: F.col("_stop").isNull() | (e["k"] < F.col("_stop"))))
    back = F.filter("p", lambda e: F.when(sell, e["b"]["close"] > F.col("price")).otherwise(e["b"]["close"] < F.col("price")))
    seq = seq.withColumn("c", F.try_element_at(back, F.lit(1))).filter("c is not null")
    upto = F.filter("p", lambda e: e["k"] <= F.col("c.k"))
    extreme = F.when(sell, F.array_min(F.transform(upto, lambda e: e["b"]["low"]))).otherwise(F.array_max(F.transform(upto, lambda e: e["b"]["high"])))
    return seq.select("symbol", F.lit("sweep").alias("concept"), up_or_down(sell).alias("direction"), F.col("t.ts").alias("occurred_at"), (F.col("c.b.ts") + B.seconds_interval(step)).alias("confirmed_at"),
                      F.col("c.b.day").alias("day"), F.col("kind").alias("level_kind"), F.col("price").alias("level_price"), F.col("available_from").alias("level_known_at"), extreme.alias("extreme"),
                      F.bround(F.abs(extreme - F.col("price")) / tick, 0).alias("penetration"))


def session_sweeps(bars: DataFrame, step: int, tick: float, sell: bool = True, pen_ticks: float = 2, reclaim: int = 3, warmup: int = 30) -> DataFrame:
    """Sweeps of the running session low (high), after ``warmup`` bars of the day."""
    w = in_day()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.min("low") if sell else F.max("high")).over(past)
    ahead = F.collect_list(F.struct("ts", "suspect", "high", "low", "close")).over(w.rowsBetween(0, reclaim - 1))
    x = bars.withColumns({"level": level, "_n": F.count(F.lit(1)).over(past), "_p": ahead, "known_at": F.lag("ts").over(w) + B.seconds_interval(step)})
    pen = pen_ticks * tick
    beyond = F.col("low") <= F.col("level") - pen if sell else F.col("high") >= F.col("level") + pen
    x = x.filter((F.col("_n") >= warmup) & ~F.col("suspect") & beyond)
    idx = F.transform("_p", lambda e, i: F.struct(i.alias("i"), e["suspect"].alias("s"), (e["close"] > F.col("level") if sell else e["close"] < F.col("level")).alias("back")))
    x = x.withColumn("_i", idx)
    bad = F.array_min(F.transform(F.filter("_i", lambda e: e["s"]), lambda e: e["i"]))
    hit = F.array_min(F.transform(F.filter("_i", lambda e: e["back"]), lambda e: e["i"]))
    x = x.withColumn("_k", hit).filter(F.col("_k").isNotNull() & F.coalesce(F.col("_k") < bad, F.lit(True)))
    used = F.slice("_p", 1, F.col("_k") + 1)
    extreme = F.array_min(F.transform(used, lambda e: e["low"])) if sell else F.array_max(F.transform(used, lambda e: e["high"]))
    confirmed = F.element_at("_p", F.col("_k") + 1)["ts"] + B.seconds_interval(step)
    return x.select(*event("session_sweep", F.lit("bullish" if sell else "bearish"), F.col("ts"), confirmed, F.lit("sessl" if sell else "sessh").alias("level_kind"), F.col("level").alias("level_price"), extreme.alias("extreme")))


# --- candle events -------------------------------------------------------------------------------------

def displacement(bars: DataFrame, step: int, consecutive: int = 1, atr_mult: float = 1.5, min_body: float = 0.6, close_pct: float = 25, min_points: float = 0,
                 require_gap: bool = False, volume_mult: float = 0, volume_lookback: int = 20) -> DataFrame:
    """A run of same-coloured candles, large against the ATR before it, closing near its extreme; accepted runs do not overlap.

    With ``volume_mult`` the run's volume must reach that multiple of the mean non-zero volume before it.  With ``require_gap`` one of
    its candles must be the middle of a price gap.  The gap of the last candle shows only when the next one has closed, so such a run is
    confirmed then; a run that no gap follows is not accepted and blocks no other.
    """
    from tidemark.operators.episodes import greedy_spaced

    w, k = in_day(), consecutive
    run = w.rowsBetween(-k + 1, 0)
    x = bars
    if volume_mult:
        def before(df, v):
            f, z = v.rowsBetween(-volume_lookback - k + 1, -k), F.when(F.col("volume") != 0, F.col("volume"))
            return df.withColumn("_avg", F.when(F.count(z).over(f) >= max(2, volume_lookback // 2), F.avg(z).over(f)))

        x = O.rolling(x, ["symbol"], volume_lookback + k, 0, before)
    clean = ~F.col("suspect") if k == 1 else contiguous(k - 1)
    x = x.withColumns({
        "_hi": F.max("high").over(run), "_lo": F.min("low").over(run), "_o": F.first("open").over(run), "_t": F.first("ts").over(run), "_n": F.count(F.lit(1)).over(run), "_clean": clean, "_vol": F.sum("volume").over(run),
        "_up": F.bool_and(F.col("close") > F.col("open")).over(run), "_dn": F.bool_and(F.col("close") < F.col("open")).over(run), "_a": F.first("atr_before").over(run), "_next": F.lead("ts").over(w),
    })
    if require_gap:
        around = contiguous(k) & F.coalesce(F.lead("run").over(w) == F.col("run"), F.lit(False)) & ~F.coalesce(F.lead("suspect").over(w), F.lit(True))
        at = lambda c, back: F.lag(c, back).over(w) if back > 0 else F.col(c) if back == 0 else F.lead(c, -back).over(w)
        left = lambda back: F.when(F.col("_up"), at("high", back + 1) < at("low", back - 1)).otherwise(at("low", back + 1) > at("high", back - 1))
        inside = [left(back) for back in range(k - 1, 0, -1)]
        x = x.withColumns({"_around": around, "_early": F.coalesce(*[F.when(g, True) for g in inside], F.lit(False)) if inside else F.lit(False), "_late": F.coalesce(left(0), F.lit(False))})
    rng = F.col("_hi") - F.col("_lo")
    near = F.when(F.col("_up"), F.col("_hi") - F.col("close")).otherwise(F.col("close") - F.col("_lo"))
    hit = x.filter((F.col("_n") == k) & F.col("_clean") & (F.col("_up") | F.col("_dn")) & F.col("_a").isNotNull() & (rng > 0) & (rng >= atr_mult * F.col("_a")) & (rng >= min_points)
                   & (F.abs(F.col("close") - F.col("_o")) >= min_body * rng) & (near <= close_pct / 100 * rng))
    if volume_mult:
        hit = hit.filter(F.col("_vol") >= volume_mult * F.col("_avg") * k)
    known = F.col("ts")
    if require_gap:
        hit = hit.filter(F.col("_around") & (F.col("_early") | F.col("_late")))
        known = F.when(F.col("_early"), F.col("ts")).otherwise(F.col("_next"))
    if k > 1:
        hit = greedy_spaced(hit, ["symbol", "day"], "bar_no", k)
    return hit.select(*event("displacement", up_or_down(F.col("_up")), F.col("_t"), known + B.seconds_interval(step), F.col("_hi").alias("high"), F.col("_lo").alias("low"), rng.alias("size"), F.col("_a").alias("atr"), F.col("bar_no")))


def with_atr_before(bars: DataFrame, period: int = 14) -> DataFrame:
    """``atr`` at each bar and ``atr_before``, the value one bar earlier."""
    x = B.with_atr(bars, period)
    return O.rolling(x, ["symbol"], 1, 0, lambda df, w: df.withColumn("atr_before", F.lag("atr").over(w)))


def candle_shape(bars: DataFrame, step: int, min_body: float = 0.6, close_pct: float = 0, engulfing: bool = False, min_points: float = 0, min_atr: float = 0) -> DataFrame:
    """Single candles by body, range, place of the close and engulfing; ``min_atr`` needs ``atr_before``."""
    w = in_day()
    x = bars.withColumns({"_po": F.lag("open").over(w), "_pc": F.lag("close").over(w), "_two": contiguous(1)})
    rng = F.col("high") - F.col("low")
    up = F.col("close") > F.col("open")
    ok = ~F.col("suspect") & (F.col("bar_no") > 0) & (rng > 0) & (F.col("close") != F.col("open")) & (F.abs(F.col("close") - F.col("open")) >= min_body * rng)
    if min_points:
        ok = ok & (rng >= min_points)
    if min_atr:
        ok = ok & (rng >= min_atr * F.col("atr_before"))
    if close_pct:
        ok = ok & (F.when(up, F.col("high") - F.col("close")).otherwise(F.col("close") - F.col("low")) <= close_pct / 100 * rng)
    if engulfing:
        ok = ok & F.col("_two") & (F.least("open", "close") <= F.least("_po", "_pc")) & (F.greatest("open", "close") >= F.greatest("_po", "_pc")) & ((F.col("_pc") - F.col("_po")) * (F.col("close") - F.col("open")) < 0)
    return x.filter(ok).select(*event("candle", up_or_down(up), F.col("ts"), close_time(step), F.when(up, F.col("low")).otherwise(F.col("high")).alias("extreme")))


def directional_move(bars: DataFrame, step: int, lookback: int = 6, min_points: float = 0, min_atr: float = 2.0) -> DataFrame:
    """First bar of each stretch where the move over ``lookback`` bars is large enough."""
    w = in_day()
    x = bars.withColumns({"_m": F.col("close") - F.lag("close", lookback).over(w), "_a": F.lag("atr", lookback).over(w), "_c": contiguous(lookback), "_t": F.lag("ts", lookback - 1).over(w),
                          "_lo": F.min("low").over(w.rowsBetween(-lookback, 0)), "_hi": F.max("high").over(w.rowsBetween(-lookback, 0))})
    need = F.greatest(F.lit(float(min_points)), min_atr * F.col("_a"))
    valid = F.col("_c") & F.col("_a").isNotNull()
    x = x.withColumns({"_up": F.coalesce(valid & (F.col("_m") >= need), F.lit(False)), "_dn": F.coalesce(valid & (-F.col("_m") >= need), F.lit(False))})
    was = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False))
    x = x.withColumns({"_nu": F.col("_up") & ~was("_up"), "_nd": F.col("_dn") & ~was("_dn")}).filter("_nu or _nd")
    return x.select(*event("directional_move", up_or_down(F.col("_nu")), F.col("_t"), close_time(step), F.col("_m").alias("move"), F.when(F.col("_nu"), F.col("_lo")).otherwise(F.col("_hi")).alias("extreme")))


def volume_spike(bars: DataFrame, step: int, multiple: float = 2.0, lookback: int = 20, same_time: bool = False, min_days: int = 3) -> DataFrame:
    """Volume against the previous candles' non-zero average, or against the same clock time on earlier days."""
    v = F.when(F.col("volume") != 0, F.col("volume"))
    if same_time:
        wall = cal.to_et(F.col("ts"))
        w = Window.partitionBy("symbol", "_clock").orderBy("ts").rowsBetween(-lookback, -1)
        # One row per day and clock minute: bounded by the calendar.
        x = bars.withColumn("_clock", F.date_format(wall, "HH:mm")).filter("volume <> 0").withColumn("_v", v)
        x = x.withColumn("_avg", F.when(F.count("_v").over(w) >= min_days, F.avg("_v").over(w)))
    else:
        def build(df, w):
            f = w.rowsBetween(-lookback, -1)
            return df.withColumn("_avg", F.when(F.count("_v").over(f) >= max(2, lookback // 2), F.avg("_v").over(f)))

        x = O.rolling(bars.withColumn("_v", v), ["symbol"], lookback, 0, build)
    hit = x.filter(~F.col("suspect") & (F.col("volume") >= multiple * F.col("_avg")) & (F.col("close") != F.col("open")))
    return hit.select(*event("volume_spike", up_or_down(F.col("close") > F.col("open")), F.col("ts"), close_time(step), (F.col("volume") / F.col("_avg")).alias("ratio")))


def vol_expansion(bars: DataFrame, step: int, multiple: float = 1.5) -> DataFrame:
    """Candle range against the ATR before it."""
    rng = F.col("high") - F.col("low")
    hit = bars.filter(~F.col("suspect") & F.col("atr_before").isNotNull() & (F.col("close") != F.col("open")) & (rng >= multiple * F.col("atr_before")))
    return hit.select(*event("volatility_expansion", up_or_down(F.col("close") > F.col("open")), F.col("ts"), close_time(step), (rng / F.col("atr_before")).alias("ratio")))


def atr_ratio_expansion(bars: DataFrame, step: int, fast: int = 5, slow: int = 50, multiple: float = 1.5) -> DataFrame:
    """Fast ATR rising through a multiple of slow ATR, judged against the previous clean bar."""
    x = B.with_atr(B.with_atr(bars, fast, "_f"), slow, "_s").filter(F.col("_f").isNotNull() & F.col("_s").isNotNull() & ~F.col("suspect"))
    x = x.withColumn("_now", (F.col("_f") >= multiple * F.col("_s")).cast("int"))
    x = O.carry_last(x, ["symbol"], "day", ["ts"], {"_was": "_now"}, include_current=False)
    hit = x.filter((F.col("_now") == 1) & (F.coalesce("_was", F.lit(0)) == 0))
    return hit.select(*event("volatility_expansion", F.lit(None).cast("string"), F.col("ts"), close_time(step), (F.col("_f") / F.col("_s")).alias("ratio")))


def opening_range_breakout(ranges: DataFrame, bars: DataFrame, step: int) -> DataFrame:
    """First clean close beyond the opening range inside its validity."""
    r = ranges.select("symbol", "day", F.col("high").alias("r_high"), F.col("low").alias("r_low"), "available_from", "valid_until")
    x = bars.join(r, ["symbol", "day"]).filter(
        (close_time(step) > F.col("available_from")) & (close_time(step) <= F.col("valid_until")) & ~F.col("suspect") & ((F.col("close") > F.col("r_high")) | (F.col("close") < F.col("r_low"))))
    g = x.groupBy("symbol", "day").agg(F.min_by(F.struct("ts", "close", "r_high", "r_low"), "ts").alias("b"))
    up = F.col("b.close") > F.col("b.r_high")
    return g.select(*event("opening_range", up_or_down(up), F.col("b.ts"), F.col("b.ts") + B.seconds_interval(step), F.when(up, F.col("b.r_high")).otherwise(F.col("b.r_low")).alias("level")))


def vwap_cross(bars_with_vwap: DataFrame, step: int) -> DataFrame:
    """Side change of the close against VWAP between two neighbouring defined, clean bars."""
    x = bars_with_vwap.withColumn("_side", F.when(F.col("vwap").isNotNull() & ~F.col("suspect"), F.col("close") > F.col("vwap")))
    x = O.rolling(x, ["symbol"], 1, 0, lambda df, w: df.withColumn("_was", F.lag("_side").over(w)))
    hit = x.filter(F.col("_side") != F.col("_was"))
    return hit.select(*event("vwap", up_or_down(F.col("_side")), F.col("ts"), close_time(step), F.col("vwap").alias("level")))


# --- market structure ----------------------------------------------------------------------------------

def structure(bars: DataFrame, sw: DataFrame, step: int, max_age: int = 200, mss_atr: float = 1.0, mss_body: float = 0.5, by: str = "close", kind: str = "any") -> DataFrame:
    """Breaks of the most recent confirmed, unbroken swing by a close (or, ``by`` wick, a trade) beyond it, labelled break / BOS / CHoCH / MSS.

    ``kind`` keeps bos (with the trend), choch (against it, MSS included) or mss; the trend counts every break.

    No sequential state is needed for the breaks.  A swing hidden under a newer, higher one is
    removed together with it and never counts, so each swing's fate is its first close beyond it;
    a break exists at bar j when the newest swing not closed beyond before j is closed beyond at j.
    Every join is an equality on position blocks of ``max_age`` bars.  Only the trend, the side of
    the previous break, is carried along the (few) breaks.
    """
    side = F.when(F.col("kind") == "swingh", "bullish").otherwise("bearish")
    s = sw.select("symbol", "regime", side.alias("side"), F.col("bar_no").alias("s_no"), "price", "confirmed_at", F.col("occurred_at").alias("swing_at"))
    blk = lambda c: F.floor(c / max_age)
    spread = s.withColumn("_b", F.explode(F.array(blk(F.col("s_no")), blk(F.col("s_no")) + 1)))
    b = bars.filter(~F.col("suspect")).select("symbol", "regime", blk(F.col("bar_no")).alias("_b"), "bar_no", "ts", F.col("close" if by == "close" else "high").alias("_up"), F.col("close" if by == "close" else "low").alias("_dn"))
    past = F.when(F.col("side") == "bullish", F.col("_up") > F.col("price")).otherwise(F.col("_dn") < F.col("price"))
    broken = spread.join(b, ["symbol", "regime", "_b"]).filter(
        (F.col("bar_no") > F.col("s_no")) & (F.col("bar_no") - F.col("s_no") <= max_age) & (F.col("ts") >= F.col("confirmed_at")) & past)
    fate = broken.groupBy("symbol", "regime", "side", "s_no", "price", "confirmed_at", "swing_at").agg(F.min("bar_no").alias("j"), F.min("ts").alias("ts"))
    # Newest swing closed beyond at each bar, and the newest known swing still standing there.
    brk = fate.groupBy("symbol", "regime", "side", "j", "ts").agg(F.max_by(F.struct("s_no", "price", "swing_at", "confirmed_at"), "s_no").alias("s"))
    standing = s.join(fate.select("symbol", "side", "s_no", F.col("j").alias("gone")), ["symbol", "side", "s_no"], "left")
    standing = standing.select("symbol", "regime", "side", F.col("s_no").alias("u_no"), F.col("confirmed_at").alias("u_known"), "gone").withColumn(
        "_b", F.explode(F.array(blk(F.col("u_no")), blk(F.col("u_no")) + 1)))
    hidden = brk.withColumn("_b", blk(F.col("j"))).join(standing, ["symbol", "regime", "side", "_b"]).filter(
        (F.col("u_no") > F.col("s.s_no")) & (F.col("u_known") <= F.col("ts")) & (F.col("j") - F.col("u_no") <= max_age) & (F.col("gone").isNull() | (F.col("gone") > F.col("j"))))
    brk = brk.join(hidden.select("symbol", "side", "j"), ["symbol", "side", "j"], "left_anti")
    info = bars.select("symbol", F.col("bar_no").alias("j"), "day", "high", "low", "open", "close", "atr_before")
    e = brk.join(info, ["symbol", "j"]).withColumn("_o", F.when(F.col("side") == "bullish", 0).otherwise(1))
    e = O.carry_last(e.withColumn("_key", F.concat_ws("|", "symbol", "regime")), ["_key"], "day", ["j", "_o"], {"_trend": "side"}, include_current=False)
    rng = F.col("high") - F.col("low")
    disp = F.coalesce((F.col("j") > 0) & (rng > 0) & (rng >= mss_atr * F.col("atr_before")) & (F.abs(F.col("close") - F.col("open")) >= mss_body * rng), F.lit(False))
    label = F.when(F.col("_trend").isNull(), "break").when(F.col("_trend") == F.col("side"), "BOS").when(disp, "MSS").otherwise("CHoCH")
    e = e.withColumn("_kind", label)
    if kind != "any":
        e = e.filter(F.col("_kind").isin({"bos": ["BOS"], "choch": ["CHoCH", "MSS"], "mss": ["MSS"]}[kind]))
    return e.select(*event("market_structure_break", F.col("side"), F.col("ts"), close_time(step), F.col("_kind").alias("type"), F.col("s.price").alias("level"), F.col("s.swing_at").alias("swing_at"), disp.alias("displacement"),
                           F.when(F.col("side") == "bullish", F.col("low")).otherwise(F.col("high")).alias("extreme"), F.col("j").alias("bar_no")))


def smt(sw: DataFrame, own: DataFrame, other: DataFrame, step: int, lookback: int = 40, lag: int = 3, min_diff: float = 0.0) -> DataFrame:
    """Two consecutive swings where one market makes a new extreme and the other does not.

    ``other`` is the comparison market of every symbol, or, with a symbol column, each symbol's own.
    """
    p = O.carry_last(sw.withColumn("_k", F.concat_ws("|", "symbol", "kind")), ["_k"], "day", ["bar_no"], {"prev": F.struct("bar_no", "price", "occurred_at", "regime")}, include_current=False)
    p = p.filter(F.col("prev").isNotNull() & (F.col("bar_no") - F.col("prev.bar_no") <= lookback) & (F.col("regime") == F.col("prev.regime")))
    off = F.explode(F.sequence(F.lit(-lag), F.lit(lag)))
    ask = p.withColumn("which", F.explode(F.array(F.lit("cur"), F.lit("prev")))).withColumn("_o", off)
    base = F.when(F.col("which") == "cur", F.col("occurred_at")).otherwise(F.col("prev.occurred_at"))
    ask = ask.withColumn("ts", F.timestamp_seconds(F.unix_seconds(base) + F.col("_o") * step))
    same = ["symbol", "ts"] if "symbol" in other.columns else ["ts"]
    o = other.filter(~F.col("suspect")).select(*same, F.col("high").alias("oh"), F.col("low").alias("ol"), F.col("regime").alias("o_reg"))
    low = F.col("kind") == "swingl"
    g = ask.join(o, same).groupBy("symbol", "kind", "price", "occurred_at", "confirmed_at", "bar_no", "day", "prev", "which").agg(
        F.count(F.lit(1)).alias("n"), F.min("ol").alias("lo"), F.max("oh").alias("hi"), F.max(F.when(F.col("_o") == 0, F.col("o_reg"))).alias("o_reg")).filter(F.col("n") == 2 * lag + 1)
    g = g.withColumn("x", F.when(low, F.col("lo")).otherwise(F.col("hi")))
    e = g.groupBy("symbol", "kind", "price", "occurred_at", "confirmed_at", "bar_no", "day", "prev").agg(
        F.max(F.when(F.col("which") == "cur", F.col("x"))).alias("cx"), F.max(F.when(F.col("which") == "prev", F.col("x"))).alias("px"), F.count(F.lit(1)).alias("_m"), F.min("o_reg").alias("_r0"), F.max("o_reg").alias("_r1"))
    da, db = F.col("price") - F.col("prev.price"), F.col("cx") - F.col("px")
    e = e.filter((F.col("_m") == 2) & (F.col("_r0") == F.col("_r1")) & ((da > 0) != (db > 0)) & (F.abs(da) >= min_diff) & (F.abs(db) >= min_diff))
    known = F.greatest(F.col("confirmed_at"), F.timestamp_seconds(F.unix_seconds("occurred_at") + (lag + 1) * step))
    return e.select("symbol", F.lit("smt_divergence").alias("concept"), F.when(low, "bullish").otherwise("bearish").alias("direction"), "occurred_at", known.alias("confirmed_at"), "day", F.col("price").alias("extreme"), da.alias("own_change"), db.alias("other_change"))


def union_events(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
