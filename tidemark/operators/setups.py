"""Ordered matching of several conditions, forward outcomes of the matches, and their statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.maths import ratio
from tidemark.operators import bars as B
from tidemark.operators import ordered as O
from tidemark.session import cut_lineage

WITHIN_DEFAULT = 30  # fixed value: minutes of "within the last N minutes"


def level_at(points: DataFrame, levels: DataFrame, t: str) -> DataFrame:
    """Latest level of each kind usable at a time: equality on (symbol, day) plus the validity range."""
    lv = levels.select("symbol", "kind", "price", "available_from", "valid_until")
    days = F.sequence(F.to_date(F.col("available_from") - B.seconds_interval(86400)), F.to_date(F.col("valid_until") + B.seconds_interval(86400)))
    spread = lv.withColumn("day", F.explode(days))
    x = points.join(spread, ["symbol", "day"]).filter((F.col("available_from") <= F.col(t)) & (F.col(t) < F.col("valid_until")))
    return x.groupBy(*points.columns, "kind").agg(F.max_by("price", "available_from").alias("price"))


@dataclass(frozen=True)
class Step:
    """One earlier condition of a setup: its events (symbol, t, direction) and how far back it may lie."""

    name: str
    events: DataFrame
    timing: str = "any"  # "any", "at", "session", "within"
    minutes: int = WITHIN_DEFAULT
    context: bool = False


@dataclass(frozen=True)
class State:
    """A condition that lasts: spans (symbol, start, end, direction), a null end still open.

    It holds where a span has begun by the bound and the trigger lies in it, or at most ``minutes`` after its end.
    """

    name: str
    spans: DataFrame
    minutes: int = 0
    context: bool = False


@dataclass(frozen=True)
class LevelCheck:
    """The trigger's close against the newest level of a kind usable at that time; without a level it fails."""

    name: str
    levels: DataFrame
    kind: str
    above: bool = True


@dataclass(frozen=True)
class ClockCheck:
    """The trigger lies between two minutes of the New York day."""

    name: str
    start: int
    end: int


Condition = Step | State | LevelCheck | ClockCheck


def trading_day_of(t: Column) -> Column:
    """Event times are bar closes, so the day is that of the second before."""
    return cal.trading_day(t - B.seconds_interval(1))


def pick_latest(setups: DataFrame, events: DataFrame, bound: Column, name: str) -> DataFrame:
    """Newest event not after ``bound`` whose direction fits; one merged pass per condition, no range join."""
    hit = F.struct(F.col("_t").alias("t"), F.col("_d").alias("d"))
    left = setups.select("symbol", bound.alias("_t"), F.lit(1).alias("_side"), F.struct(*[c for c in setups.columns if c != "symbol"]).alias("_l"))
    right = events.select("symbol", F.col("t").alias("_t"), F.lit(0).alias("_side"), F.col("direction").alias("_d"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_chunk", F.date_trunc("day", "_t"))
    is_event = F.col("_side") == 0
    both = O.carry_last(both, ["symbol"], "_chunk", ["_t", "_side"], {
        "_up": F.when(is_event & (F.col("_d") == "bullish"), hit), "_dn": F.when(is_event & (F.col("_d") == "bearish"), hit), "_no": F.when(is_event & F.col("_d").isNull(), hit)})
    want = F.col("_l.direction")
    allowed = F.array("_no", F.when(want.isNull() | (want == "bullish"), F.col("_up")), F.when(want.isNull() | (want == "bearish"), F.col("_dn")))
    return both.filter("_side = 1").select("symbol", "_l.*", F.array_max(F.filter(allowed, lambda h: h.isNotNull())).alias(name))


def _keyed(x: DataFrame) -> DataFrame:
    """Rows stored with a key, so that what is found for a row comes back by equality."""
    return cut_lineage(x.withColumn("_row", F.monotonically_increasing_id()))


def pick_state(setups: DataFrame, state: State, bound: Column) -> DataFrame:
    """Start and direction of the newest span that has begun by ``bound`` and covers the trigger; spans are dealt to the days they reach."""
    x = _keyed(setups)
    last = x.agg((F.max("t") + B.seconds_interval(1)).alias("t")).scalar()
    ends = F.coalesce(F.col("end"), last) + B.seconds_interval(60 * state.minutes)
    spans = state.spans.select("symbol", F.col("start").alias("_s"), ends.alias("_e"), F.col("direction").alias("_d")).filter("_s < _e")
    spans = spans.withColumn("_day", F.explode(F.sequence(F.to_date("_s"), F.to_date("_e"))))
    fits = F.col("direction").isNull() | F.col("_d").isNull() | (F.col("direction") == F.col("_d"))
    near = x.select("_row", "symbol", "t", "direction", bound.alias("_b"), F.to_date("t").alias("_day")).join(spans, ["symbol", "_day"])
    near = near.filter((F.col("_s") <= F.least("_b", "t")) & (F.col("t") < F.col("_e")) & fits)
    best = near.groupBy("_row").agg(F.max(F.struct(F.col("_s").alias("t"), F.col("_d").alias("d"))).alias("_p"))
    return x.join(best, "_row", "left").drop("_row")


def check_level(setups: DataFrame, check: LevelCheck) -> DataFrame:
    """Add ``_ok``: the close lies on the asked side of the level."""
    x = _keyed(setups)
    points = x.select("_row", "symbol", "t", F.to_date("t").alias("day"))
    at = level_at(points, check.levels.filter(F.col("kind") == check.kind), "t").select("_row", F.col("price").alias("_price"))
    side = F.col("close") > F.col("_price")
    return x.join(at, "_row", "left").withColumn("_ok", F.coalesce(side if check.above else ~side, F.lit(False))).drop("_row", "_price")


def match_chain(triggers: DataFrame, steps: Sequence[Condition], ordered: bool = True, drop: str | None = None) -> DataFrame:
    """Walk back from each trigger through ``steps`` (last condition first).

    Adds per step the picked time, whether it holds, and ``fails``: the first step that did not.
    Events and states move the bound of the next condition back; checks are made at the trigger alone (a level check reads its ``close``).
    All timing rules are lower bounds, so the newest admissible event satisfies them if any does.
    ``drop`` names a boolean-map column saying which steps are relaxed for a row.
    """
    x = triggers.withColumn("_upper", F.col("t")).withColumn("fails", F.lit(None).cast("string"))
    for i, s in enumerate(steps):
        if i:
            x = cut_lineage(x)  # each pick reads its input twice; without this the work doubles per condition
        relaxed = F.coalesce(F.col(drop)[s.name], F.lit(False)) if drop else F.lit(False)
        if isinstance(s, LevelCheck | ClockCheck):
            x = check_level(x, s) if isinstance(s, LevelCheck) else x.withColumn("_ok", cal.in_window(F.col("t") - B.seconds_interval(1), s.start, s.end))
            x = x.withColumn(f"ok_{s.name}", F.col("_ok")).drop("_ok")
            x = x.withColumn("fails", F.coalesce("fails", F.when(~F.col(f"ok_{s.name}") & ~relaxed, F.lit(s.name))))
            continue
        bound = F.col("_upper") if ordered and not s.context else F.col("t")
        x = pick_state(x, s, bound) if isinstance(s, State) else pick_latest(x, s.events, bound, "_p")
        at = F.col("_p.t")
        ok = at.isNotNull()
        if isinstance(s, State):
            pass
        elif s.timing == "at":
            ok = ok & (at == F.col("t"))
        elif s.timing == "session":
            ok = ok & (trading_day_of(at) == trading_day_of(F.col("t")))
        elif s.timing == "within":
            ok = ok & (at >= F.col("t") - B.seconds_interval(60 * s.minutes))
        x = x.withColumn(f"ok_{s.name}", F.coalesce(ok, F.lit(False))).withColumn(f"at_{s.name}", at)
        held = F.col(f"ok_{s.name}") & ~relaxed
        x = x.withColumn("fails", F.coalesce("fails", F.when(~F.col(f"ok_{s.name}") & ~relaxed, F.lit(s.name))))
        x = x.withColumn("direction", F.coalesce("direction", F.when(held, F.col("_p.d"))))
        if ordered and not s.context:
            x = x.withColumn("_upper", F.when(held, at).otherwise(F.col("_upper")))
        x = x.drop("_p")
    return x.drop("_upper")


def funnel(matched: DataFrame, steps: Sequence[Condition]) -> DataFrame:
    """Triggers and the survivors of each check, in checking order."""
    parts, acc = [F.struct(F.lit(0).alias("step"), F.lit("trigger").alias("name"), F.lit(True).alias("alive"))], F.lit(True)
    for i, s in enumerate(steps, 1):
        acc = acc & F.col(f"ok_{s.name}")
        parts.append(F.struct(F.lit(i).alias("step"), F.lit(s.name).alias("name"), acc.alias("alive")))
    x = matched.select("symbol", F.explode(F.array(*parts)).alias("f")).select("symbol", "f.*")
    return x.groupBy("symbol", "step", "name").agg(F.count_if("alive").alias("remaining"))


def diagnose(funnel_rows: DataFrame, days: DataFrame, covered: DataFrame) -> DataFrame:
    """The check that removed most triggers, the days seen and how many of them had a usable level."""
    w = Window.partitionBy("symbol").orderBy("step")
    f = funnel_rows.withColumn("lost", F.lag("remaining").over(w) - F.col("remaining")).filter("lost is not null")
    worst = f.groupBy("symbol").agg(F.max_by(F.struct("name", "lost"), F.struct(F.col("lost"), (-F.col("step")).alias("s"))).alias("w"))
    d = days.groupBy("symbol").agg(F.count_distinct("day").alias("days"))
    c = covered.groupBy("symbol").agg(F.count_distinct("day").alias("covered"))
    x = worst.join(d, "symbol").join(c, "symbol", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return x.select("symbol", F.col("w.name").alias("most_restrictive"), F.col("w.lost").alias("lost"), "days", "covered", (F.col("covered") < 0.6 * F.col("days")).alias("thin_levels"))


def relaxed(triggers: DataFrame, steps: Sequence[Condition]) -> DataFrame:
    """Setups that remain for every subset of dropped conditions, matched in one run.

    The subset number grows with the conditions, not the data (at most 2^5 for six conditions).
    """
    names = [s.name for s in steps]
    masks = F.array(*[F.struct(F.lit(",".join(n for i, n in enumerate(names) if m >> i & 1)).alias("dropped"),
                               F.create_map(*[v for i, n in enumerate(names) for v in (F.lit(n), F.lit(bool(m >> i & 1)))]).alias("drop")) for m in range(2 ** len(names))])
    x = triggers.withColumn("_m", F.explode(masks)).select("*", "_m.*").drop("_m")
    x = match_chain(x, steps, drop="drop")
    return x.groupBy("symbol", "dropped").agg(F.count_if(F.col("fails").isNull()).alias("remaining"), F.count(F.lit(1)).alias("triggers"))


# --- forward outcomes ----------------------------------------------------------------------------------

OPEN = "open"  # reason of a setup without an exit yet


def barrier_outcomes(setups: DataFrame, bars: DataFrame, step: int, combos: Sequence[tuple[float, float]], limit_bars: int = 12, point_value: float = 1.0, cost: float = 0.0) -> DataFrame:
    """First of day end, stop, target or time limit on the bars after each setup, for every (stop, target) pair.

    ``setups`` carries symbol, bar_no, t, direction, entry and atr.  Forward bars arrive by equality on
    position, once per setup; the pairs are expanded afterwards from the collected short path.  A setup without a forward
    bar, or whose bars end before any exit, stays with the reason ``open`` and no exit or result.
    """
    b = bars.select("symbol", F.col("bar_no").alias("_n"), F.struct("ts", "day", "suspect", "open", "high", "low", "close").alias("b"))
    x = setups.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(limit_bars)))).withColumn("_n", F.col("bar_no") + F.col("k")).join(b, ["symbol", "_n"], "left")
    g = x.groupBy(*setups.columns).agg(F.sort_array(F.collect_list(F.when(F.col("b").isNotNull(), F.struct("k", "b")))).alias("p"))
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("stop_atr"), F.lit(float(r)).alias("target_r")) for a, r in combos])
    g = g.withColumn("c", F.explode(pairs)).select("*", "c.*").drop("c")
    sign = F.when(F.col("direction") == "bullish", 1.0).otherwise(-1.0)
    g = g.withColumns({"sign": sign, "risk": F.col("atr") * F.col("stop_atr")}).filter("risk > 0")
    g = g.withColumns({"stop": F.col("entry") - F.col("sign") * F.col("risk"), "target": F.col("entry") + F.col("sign") * F.col("target_r") * F.col("risk")})
    g = g.withColumn("day0", F.get("p", F.lit(0))["b"]["day"])
    first = lambda cond: F.array_min(F.transform(F.filter("p", cond), lambda e: e["k"]))
    hits = lambda price, worse: (lambda e: F.when((F.col("sign") > 0) == F.lit(worse), e["b"]["low"] <= F.col(price)).otherwise(e["b"]["high"] >= F.col(price)))
    hit_stop, hit_target = hits("stop", True), hits("target", False)
    g = g.withColumns({
        "_day": first(lambda e: e["b"]["day"] != F.col("day0")), "_stop": first(hit_stop), "_target": first(hit_target),
        "_time": first(lambda e: F.unix_seconds(e["b"]["ts"]) + step - F.unix_seconds("t") >= limit_bars * step)})
    g = g.withColumn("_k", F.least("_day", "_stop", "_target", "_time"))  # null: no exit among the bars there are
    reason = F.when(F.col("_k").isNull(), OPEN).when(F.col("_day") == F.col("_k"), "end of trading day").when(F.col("_stop") == F.col("_k"), "stop").when(F.col("_target") == F.col("_k"), "target").otherwise("time exit")
    g = g.withColumn("reason", reason).withColumn("_x", F.when(F.col("reason") == "end of trading day", F.col("_k") - 1).otherwise(F.col("_k")))
    at = F.try_element_at(F.filter("p", lambda e: e["k"] == F.col("_x")), F.lit(1))
    g = g.withColumn("_b", at["b"])
    op = F.col("_b.open")
    stop_fill = F.when(F.col("sign") * (op - F.col("stop")) <= 0, op).otherwise(F.col("stop"))
    target_fill = F.when(F.col("sign") * (op - F.col("target")) >= 0, op).otherwise(F.col("target"))
    g = g.withColumn("exit", F.when(F.col("reason") == "stop", stop_fill).when(F.col("reason") == "target", target_fill).otherwise(F.col("_b.close")))
    seen = F.filter("p", lambda e: e["k"] <= F.col("_x"))
    top, low = F.array_max(F.transform(seen, lambda e: e["b"]["high"])), F.array_min(F.transform(seen, lambda e: e["b"]["low"]))
    closed = lambda c: F.when(F.col("reason") != OPEN, c)
    g = g.withColumns({
        "mfe": closed(F.greatest(F.lit(0.0), F.when(F.col("sign") > 0, top - F.col("entry")).otherwise(F.col("entry") - low))),
        "mae": closed(F.greatest(F.lit(0.0), F.when(F.col("sign") > 0, F.col("entry") - low).otherwise(top - F.col("entry")))),
        "ambiguous": (F.col("reason") == "stop") & F.coalesce(F.col("_target") == F.col("_k"), F.lit(False)),
        "suspect": F.exists(seen, lambda e: e["b"]["suspect"]), "points": (F.col("exit") - F.col("entry")) * F.col("sign"),
        "exit_time": F.col("_b.ts") + B.seconds_interval(step)})
    g = g.withColumns({"gross": F.col("points") * point_value, "net": F.col("points") * point_value - cost})
    g = g.withColumns({"r_net": F.col("net") / (F.col("risk") * point_value), "r_gross": F.col("points") / F.col("risk"), "mfe_r": F.col("mfe") / F.col("risk"), "mae_r": F.col("mae") / F.col("risk"),
                       "minutes": (F.unix_seconds("exit_time") - F.unix_seconds("t")) / 60, "hour": F.hour(cal.to_et(F.col("t"))), "weekday": F.weekday(cal.to_et(F.col("t")))})
    return g.select("symbol", "bar_no", "t", "direction", "stop_atr", "target_r", "entry", "stop", "target", "risk", "exit", "exit_time", "reason", "points", "gross", "net", "r_net", "r_gross", "mfe_r", "mae_r", "minutes", "hour", "weekday", "ambiguous", "suspect")


def reject_counts(setups: DataFrame, tick: float, stop_col: str, min_ticks: float = 4) -> DataFrame:
    """Setups refused before entry: stop on the wrong side, or risk under ``min_ticks`` ticks."""
    sign = F.when(F.col("direction") == "bullish", 1.0).otherwise(-1.0)
    risk = sign * (F.col("entry") - F.col(stop_col))
    why = F.when(risk <= 0, "stop on the wrong side").when(risk < min_ticks * tick - 1e-9, "risk too small").otherwise("accepted")
    return setups.groupBy("symbol", why.alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))


def trade_metrics(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outcome metrics in R of clean trades; trades touching suspect bars and open ones are counted, not used.

    Everything but the medians combines map-side; medians come from the exact distributed quantile.
    """
    keys = list(keys)
    done = F.col("reason") != OPEN
    c = trades.filter(~F.col("suspect") & done)
    v = F.col("r_net")
    win, loss = F.when(v > 0, v), F.when(v < 0, v)
    a = trades.groupBy(*keys).agg(F.count_if(F.col("suspect") & done).alias("excluded_suspect"), F.count_if(~done).alias("open_at_end"))
    m = c.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(win).alias("wins"), F.count(loss).alias("losses"), F.avg(v).alias("expectancy"), F.stddev_samp(v).alias("std"), F.avg(win).alias("avg_win"),
        F.avg(loss).alias("avg_loss"), F.sum(win).alias("_w"), F.sum(loss).alias("_l"), F.avg("r_gross").alias("gross_mean"), F.avg("minutes").alias("holding_mean"), F.avg("mfe_r").alias("mfe_mean"),
        F.avg("mae_r").alias("mae_mean"), F.sqrt(F.avg(F.pow(F.least(v, F.lit(0.0)), 2))).alias("_d"))
    med = O.exact_quantiles(c, keys, "r_net", {"median": 0.5}).drop("n")
    x = a.join(m, keys).join(med, keys)
    enough = (F.col("n") >= 10) & (F.col("std") > 0)
    return x.select(*keys, "n", "excluded_suspect", "open_at_end", "wins", "losses", (F.col("wins") / F.col("n")).alias("win_rate"), "expectancy", "median", "std", "avg_win", "avg_loss", "gross_mean",
                    ratio(F.col("_w"), -F.col("_l")).alias("profit_factor"), F.when(enough, F.col("expectancy") / F.col("std")).alias("sharpe_like"), F.when(enough, ratio(F.col("expectancy"), F.col("_d"))).alias("sortino_like"),
                    "holding_mean", "mfe_mean", "mae_mean")


def grouped_results(trades: DataFrame) -> DataFrame:
    """n, mean and win rate by hour, by weekday and by exit reason from one pass (grouping sets)."""
    c = trades.filter(~F.col("suspect")).select("symbol", "hour", "weekday", "reason", "r_net")
    g = c.groupingSets([["symbol", "hour"], ["symbol", "weekday"], ["symbol", "reason"]], "symbol", "hour", "weekday", "reason").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.avg("r_net").alias("mean"), (F.count_if(F.col("r_net") > 0) / F.count(F.lit(1))).alias("win_rate"))
    field = F.when(F.col("hour").isNotNull(), "hour").when(F.col("weekday").isNotNull(), "weekday").otherwise("reason")
    return g.select("symbol", field.alias("field"), F.coalesce(F.col("hour").cast("string"), F.col("weekday").cast("string"), F.col("reason")).alias("value"), "n", "mean", "win_rate")


def streaks(trades: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: str) -> DataFrame:
    """Longest runs of wins and of losses; a zero ends both.  Runs are numbered across chunks in two levels."""
    keys = list(keys)
    x = trades.filter(~F.col("suspect")).withColumn("_s", F.signum("r_net").cast("int"))
    x = O.carry_last(x, keys, chunk, list(order), {"_p": "_s"}, include_current=False)
    x = x.withColumn("_n", F.when(F.col("_s").eqNullSafe(F.col("_p")), 0).otherwise(1))
    x = O.running(x, keys, chunk, list(order), {"_run": ("sum", "_n")})
    g = x.groupBy(*keys, "_run", "_s").agg(F.count(F.lit(1)).alias("len"))
    return g.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_s") > 0, F.col("len"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(F.col("_s") < 0, F.col("len"))), F.lit(0)).alias("max_losses"))


def cumulative_drawdown(trades: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: str) -> DataFrame:
    """Deepest fall of the running total from its highest point (at least zero)."""
    keys = list(keys)
    x = trades.filter(~F.col("suspect"))
    x = O.running(x, keys, chunk, list(order), {"equity": ("sum", "r_net")})
    x = O.running(x, keys, chunk, list(order), {"peak": ("max", "equity")})
    return x.groupBy(*keys).agg(F.least(F.min(F.col("equity") - F.greatest("peak", F.lit(0.0))), F.lit(0.0)).alias("max_drawdown"), F.sum("r_net").alias("total"))


def mid_rank(trades: DataFrame, keys: Sequence[str], actual: float) -> DataFrame:
    """Where one realised result falls among comparable ones, with a verdict."""
    c = trades.filter(~F.col("suspect"))
    g = c.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r_net") < actual).alias("_b"), F.count_if(F.col("r_net") == actual).alias("_e"))
    p = (F.col("_b") + 0.5 * F.col("_e")) / F.col("n")
    verdict = F.when(F.col("n") < 10, "too few").when(p >= 0.9, "unusually strong").when(p <= 0.1, "unusually weak").otherwise("usual range")
    return g.select(*keys, "n", p.alias("percentile"), verdict.alias("verdict"))


def half_r_bins(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    b = F.least(F.greatest(F.bround(F.col("r_net") * 2, 0) / 2, F.lit(-3.0)), F.lit(5.0))
    return trades.filter(~F.col("suspect")).groupBy(*keys, (b + 0.0).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def nearest_target(setups: DataFrame, levels: DataFrame) -> DataFrame:
    """Closest usable level beyond the entry in the setup's direction."""
    lv = levels.select("symbol", F.explode(F.sequence(F.to_date(F.col("available_from") - B.seconds_interval(86400)), F.to_date(F.col("valid_until") + B.seconds_interval(86400)))).alias("day"), "kind", "price", "available_from", "valid_until")
    up = F.col("direction") == "bullish"
    x = setups.join(lv, ["symbol", "day"], "left").withColumn("_ok", (F.col("available_from") <= F.col("t")) & (F.col("t") < F.col("valid_until")) & F.when(up, (F.col("price") > F.col("entry")) & F.col("kind").endswith("h")).otherwise((F.col("price") < F.col("entry")) & F.col("kind").endswith("l")))
    p = F.when(F.col("_ok"), F.col("price"))
    return x.groupBy(*setups.columns).agg(F.when(F.first("direction") == "bullish", F.min(p)).otherwise(F.max(p)).alias("target"))
