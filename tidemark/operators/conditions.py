"""Boolean conditions on daily bars: true, false or null ("can't tell") per bar.

A condition is a function of its parameters returning a ``Measured`` pair of columns: the boolean
and the value it saw.  The frame must carry symbol, date, open, close, volume and position ``i``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import change, ratio
from tidemark.operators import indicators as I
from tidemark.operators.ordered import by_symbol


@dataclass(frozen=True)
class Measured:
    holds: Column
    value: Column


@dataclass(frozen=True)
class Condition:
    name: str
    build: Callable[..., Measured]
    defaults: dict
    warmup: Callable[[dict], int]
    prepare: Callable[[DataFrame, dict], DataFrame] | None = None


REGISTRY: dict[str, Condition] = {}


def condition(name: str, warmup: Callable[[dict], int], prepare=None, **defaults):
    def add(fn):
        REGISTRY[name] = Condition(name, fn, defaults, warmup, prepare)
        return fn

    return add


def beyond(move: Column, direction: str, pct: float) -> Column:
    return move <= -pct / 100 if direction == "falls" else move >= pct / 100


def compare(a: Column, b, op: str) -> Column:
    return a > b if op == "above" else a < b


@condition("price_move", lambda p: p["window"], direction="falls", threshold=5, window=5)
def price_move(direction, threshold, window) -> Measured:
    move = I.returns(lag=window)
    return Measured(beyond(move, direction, threshold), move)


@condition("drawdown_from_high", lambda p: p["lookback"], threshold=20, lookback=252)
def drawdown_from_high(threshold, lookback) -> Measured:
    peak = F.max("close").over(I.trailing(lookback))
    ready = F.col("i") >= lookback - 1
    return Measured(F.when(ready, F.col("close") <= peak * (1 - threshold / 100)), F.when(ready, F.col("close") / peak - 1))


@condition("new_extreme", lambda p: p["lookback"] + 1, kind="high", lookback=252)
def new_extreme(kind, lookback) -> Measured:
    prior = (F.max if kind == "high" else F.min)("close").over(I.trailing(lookback, include_today=False))
    ready = F.col("i") >= lookback
    beaten = F.col("close") > prior if kind == "high" else F.col("close") < prior
    return Measured(F.when(ready, beaten), F.when(ready, F.col("close") / prior - 1))


@condition("gap", lambda p: 1, direction="rises", threshold=3)
def gap(direction, threshold) -> Measured:
    jump = change(F.col("open"), F.lag("close").over(by_symbol()))
    return Measured(beyond(jump, direction, threshold), jump)


@condition("relative_volume", lambda p: p["lookback"], op="above", multiple=1.5, lookback=20)
def relative_volume(op, multiple, lookback) -> Measured:
    times = ratio(F.coalesce("volume", F.lit(0.0)), I.trailing_mean(lookback, "_volume0"))
    return Measured(compare(times, multiple, op), times)


@condition("rsi", lambda p: p["period"] * 3, op="below", level=30, period=14,
           prepare=lambda df, p: I.with_rsi(df, p["period"], f"_rsi{p['period']}"))
def rsi(op, level, period) -> Measured:
    value = F.col(f"_rsi{period}")
    return Measured(F.when(F.col("i") >= 3 * period, compare(value, level, op)), value)


@condition("ma_position", lambda p: p["period"], op="above", period=200)
def ma_position(op, period) -> Measured:
    average = I.sma(period)
    return Measured(compare(F.col("close"), average, op), F.col("close") / average - 1)


@condition("ma_cross", lambda p: p["period"] + 1, op="above", period=50)
def ma_cross(op, period) -> Measured:
    w = by_symbol()
    side, before = F.col("close") - F.col(f"_sma{period}"), F.lag(F.col("close") - F.col(f"_sma{period}")).over(w)
    crossed = (before <= 0) & (side > 0) if op == "above" else (before >= 0) & (side < 0)
    return Measured(F.when(side.isNotNull() & before.isNotNull(), crossed), F.col("close") / F.col(f"_sma{period}") - 1)


def _with_sma(df: DataFrame, p: dict) -> DataFrame:
    return df.withColumn(f"_sma{p['period']}", I.sma(p["period"]))


REGISTRY["ma_cross"] = Condition("ma_cross", ma_cross, {"op": "above", "period": 50}, lambda p: p["period"] + 1, _with_sma)


@condition("earnings", lambda p: 2, result="any", reaction="any", threshold=0)
def earnings(result, reaction, threshold) -> Measured:
    """Needs ``surprise``, ``has_report`` and ``first_report_i`` from ``with_reports``."""
    move, has = I.returns(), F.coalesce("has_report", F.lit(False))
    wanted = {"beat": F.col("surprise") > 0, "miss": F.col("surprise") < 0}.get(result, F.lit(True))
    reacted = {"rises": move >= threshold / 100, "falls": move <= -threshold / 100}.get(
        reaction, F.abs(move) >= threshold / 100
    )
    hit = has & F.coalesce(wanted, F.lit(False)) & F.coalesce(reacted, F.lit(False))
    known = (F.col("i") >= F.col("first_report_i")) & (F.col("i") > 0)
    return Measured(F.when(known, hit), F.when(has, move))


def with_reports(daily: DataFrame, sessions: DataFrame) -> DataFrame:
    """Attach reacting sessions (symbol, i, surprise) and the symbol's first one."""
    s = sessions.select("symbol", "i", "surprise", F.lit(True).alias("has_report"))
    first = s.groupBy("symbol").agg(F.min("i").alias("first_report_i"))
    return daily.join(s, ["symbol", "i"], "left").join(first, "symbol", "left")


def evaluate(daily: DataFrame, conditions: dict[str, tuple[str, dict]]) -> DataFrame:
    """Add ``<id>`` and ``<id>_value`` for every ``{id: (condition name, params)}``."""
    df = daily if "i" in daily.columns else I.numbered(daily)
    df = df.withColumn("_volume0", F.coalesce("volume", F.lit(0.0)))
    for name, params in conditions.values():
        c = REGISTRY[name]
        if c.prepare:
            df = c.prepare(df, {**c.defaults, **params})
    cols = {}
    for cid, (name, params) in conditions.items():
        c = REGISTRY[name]
        m = c.build(**{**c.defaults, **params})
        cols[cid], cols[f"{cid}_value"] = m.holds, m.value
    out = df.withColumns(cols)
    return out.drop(*[x for x in out.columns if x.startswith("_") and x not in daily.columns])


def warmup(conditions: dict[str, tuple[str, dict]]) -> int:
    return max(REGISTRY[n].warmup({**REGISTRY[n].defaults, **p}) for n, p in conditions.values())


def combine(logic: dict | str) -> Column:
    """Fold ``{"op": "AND"|"OR", "items": [...]}`` over condition columns; null counts as not true."""
    if isinstance(logic, str):
        return F.coalesce(F.col(logic), F.lit(False))
    parts = [combine(item) for item in logic["items"]]
    return reduce(lambda a, b: a & b if logic["op"] == "AND" else a | b, parts)


def leaves(logic: dict | str) -> list[str]:
    return [logic] if isinstance(logic, str) else [x for item in logic["items"] for x in leaves(item)]


def check_logic(logic: dict | str, conditions: dict) -> None:
    """Every condition must be used, and nothing else."""
    if set(leaves(logic)) != set(conditions):
        raise ValueError("the logic must use every condition exactly as named")
