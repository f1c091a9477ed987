"""Definitions: concepts with checked parameters, stored as JSON and compiled to DataFrames.

A concept is a daily condition or an intraday event, known by name, with a spec (kind, bounds, default) for each parameter.
``compile_definition`` turns a definition into a DataFrame through one call for all concepts; ``check_table`` validates a whole table of
definitions in Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import conditions as C
from tidemark.operators import detectors as D
from tidemark.operators import indicators as I


class DefinitionError(ValueError):
    """A definition that can't be used, with the name of what is wrong."""


@dataclass(frozen=True)
class Param:
    """One parameter: number, int, flag or choice; ``to`` is its name in the library's function."""

    kind: str
    default: object
    low: float = 0.0
    high: float = 0.0
    options: tuple = ()
    to: str | None = None

    def problem(self, value) -> str | None:
        if self.kind == "choice":
            return None if value in self.options else f"must be one of {', '.join(map(str, self.options))}"
        if self.kind == "flag":
            return None if isinstance(value, bool) else "must be true or false"
        try:
            number = float("x" if isinstance(value, bool) else value)
        except (TypeError, ValueError):
            return "must be a number"
        return None if self.low <= number <= self.high else f"must be between {self.low:g} and {self.high:g}"

    def clean(self, value):
        if self.kind == "int":
            return int(round(float(value)))
        return float(value) if self.kind == "number" else value


def number(default: float, low: float, high: float, to: str | None = None) -> Param:
    return Param("number", default, low, high, to=to)


def whole(default: int, low: int, high: int, to: str | None = None) -> Param:
    return Param("int", default, low, high, to=to)


def choice(default, *options, to: str | None = None) -> Param:
    return Param("choice", default, options=options, to=to)


def flag(to: str | None = None) -> Param:
    return Param("flag", False, to=to)


@dataclass
class Market:
    """Candles of one step and what detectors derive from them, each built once and only when a concept asks for it."""

    bars: DataFrame
    step: int
    tick: float = 0.25
    levels: DataFrame | None = None
    other: DataFrame | None = None
    _made: dict = field(default_factory=dict)

    def _once(self, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        if key not in self._made:
            self._made[key] = build()
        return self._made[key]

    def with_atr(self, period: int = 14) -> DataFrame:
        return self._once(("atr", period), lambda: D.with_atr_before(self.bars, period))

    def swings(self, left: int, right: int) -> DataFrame:
        return self._once(("swings", left, right), lambda: D.swings(self.bars, self.step, left, right))

    def opening_ranges(self, minutes: int) -> DataFrame:
        return self._once(("ranges", minutes), lambda: B.opening_ranges(self.bars, self.step, minutes))

    def vwap(self, anchor: str) -> DataFrame:
        return self._once(("vwap", anchor), lambda: B.session_vwap(self.bars, anchor))

    @cached_property
    def reference_levels(self) -> DataFrame:
        if self.levels is None:
            raise DefinitionError("this market has no reference levels")
        return self.levels


@dataclass(frozen=True)
class Concept:
    name: str
    params: dict[str, Param]
    build: Callable[[Market, dict], DataFrame] | None = None  # none: a daily condition

    @property
    def is_event(self) -> bool:
        return self.build is not None

    def checked(self, given: dict | None) -> dict:
        """All parameters, given or default; the first that is out of bounds is an error with its name."""
        out = {}
        for name, spec in self.params.items():
            value = (given or {}).get(name, spec.default)
            if problem := spec.problem(value):
                raise DefinitionError(f"{self.name}: {name} {problem}")
            out[name] = spec.clean(value)
        return out

    def arguments(self, clean: dict, *leave_out: str) -> dict:
        return {self.params[n].to or n: v for n, v in clean.items() if n not in leave_out}


# The conditions' parameters with bounds and defaults.
CONDITIONS = {
    "price_move": {"direction": choice("falls", "falls", "rises"), "threshold": number(5, 0.5, 95), "window": whole(5, 1, 252)},
    "drawdown_from_high": {"threshold": number(20, 1, 95), "lookback": whole(252, 20, 756)},
    "new_extreme": {"kind": choice("high", "high", "low"), "lookback": whole(252, 5, 756)},
    "gap": {"direction": choice("rises", "falls", "rises"), "threshold": number(3, 0.5, 50)},
    "relative_volume": {"op": choice("above", "above", "below"), "multiple": number(1.5, 0.1, 20), "lookback": whole(20, 5, 252)},
    "rsi": {"op": choice("below", "below", "above"), "level": number(30, 1, 99), "period": whole(14, 2, 50)},
    "ma_position": {"op": choice("above", "above", "below"), "period": whole(200, 5, 300)},
    "ma_cross": {"op": choice("above", "above", "below"), "period": whole(50, 5, 300)},
    "earnings": {"result": choice("any", "any", "beat", "miss"), "reaction": choice("any", "any", "rises", "falls"), "threshold": number(0, 0, 50)},
}
CONCEPTS: dict[str, Concept] = {name: Concept(name, params) for name, params in CONDITIONS.items()}
_DIRECTION = choice("either", "bullish", "bearish", "either")


def event_concept(name: str, **params: Param):
    """Register an event concept; its function gets the market and the function's arguments, and returns events.

    Every event concept has ``direction``, which keeps one side of what the function returns.
    """

    def add(fn):
        concept = Concept(name, {"direction": _DIRECTION, **params}, None)

        def build(market: Market, clean: dict) -> DataFrame:
            out = fn(market, **concept.arguments(clean, "direction"))
            return out if clean["direction"] == "either" else out.filter(F.col("direction") == clean["direction"])

        CONCEPTS[name] = Concept(name, concept.params, build)
        return fn

    return add


_SWING = {"swing_left": whole(3, 1, 50, "left"), "swing_right": whole(3, 1, 50, "right")}
_ATR = whole(14, 2, 200)


@event_concept("fvg", min_gap=number(0, 0, 10_000), min_gap_unit=choice("points", "points", "ticks", "percent", "ATR", to="unit"), atr_period=_ATR, require_displacement=flag(), min_body_ratio=number(0.6, 0, 1, "min_body"), displacement_atr=number(1, 0, 10))
def _fvg(m, atr_period, require_displacement, displacement_atr, **p):
    return D.fvg(m.with_atr(atr_period), m.step, tick=m.tick, displacement=displacement_atr if require_displacement else None, **p)


@event_concept("displacement", atr_mult=number(1.5, 0.1, 10), atr_period=_ATR, min_body_ratio=number(0.6, 0, 1, "min_body"), close_pct=number(25, 0, 100), consecutive=whole(1, 1, 10), min_points=number(0, 0, 2000), require_fvg=flag("require_gap"),
               volume_mult=number(0, 0, 20), volume_lookback=whole(20, 2, 500))
def _displacement(m, atr_period, **p):
    return D.displacement(m.with_atr(atr_period), m.step, **p)


@event_concept("market_structure_break", type=choice("any", "any", "bos", "choch", "mss", to="kind"), by=choice("close", "close", "wick"), **_SWING, max_swing_age=whole(200, 5, 5000, "max_age"), mss_atr_mult=number(1, 0, 10, "mss_atr"), mss_body_ratio=number(0.5, 0, 1, "mss_body"))
def _structure(m, left, right, **p):
    return D.structure(m.with_atr(), m.swings(left, right), m.step, **p)


@event_concept("candle", min_body_ratio=number(0, 0, 1, "min_body"), min_range_points=number(0, 0, 2000, "min_points"), min_range_atr=number(0, 0, 10, "min_atr"), atr_period=_ATR, close_location_pct=number(0, 0, 100, "close_pct"), engulfing=flag())
def _candle(m, atr_period, **p):
    return D.candle_shape(m.with_atr(atr_period) if p["min_atr"] else m.bars, m.step, **p)


@event_concept("directional_move", lookback=whole(6, 1, 500), min_points=number(0, 0, 5000), min_atr=number(2, 0, 50), atr_period=_ATR)
def _move(m, atr_period, **p):
    return D.directional_move(m.with_atr(atr_period), m.step, **p)


@event_concept("volume_spike", multiple=number(2, 1, 20), lookback=whole(20, 2, 500), same_time=flag())
def _volume(m, **p):
    return D.volume_spike(m.bars, m.step, **p)


@event_concept("volatility_expansion", mode=choice("range_vs_atr", "range_vs_atr", "atr_ratio"), multiple=number(1.5, 1, 20), atr_period=_ATR, fast=whole(5, 2, 100), slow=whole(50, 5, 1000))
def _expansion(m, mode, multiple, atr_period, fast, slow):
    return D.vol_expansion(m.with_atr(atr_period), m.step, multiple) if mode == "range_vs_atr" else D.atr_ratio_expansion(m.bars, m.step, fast, slow, multiple)


@event_concept("opening_range", minutes=choice(15, 5, 15, 30, 60, 120))
def _opening_range(m, minutes):
    return D.opening_range_breakout(m.opening_ranges(minutes), m.bars, m.step)


@event_concept("vwap", anchor=choice("rth", "globex", "rth"))
def _vwap(m, anchor):
    return D.vwap_cross(m.vwap(anchor), m.step)


@event_concept("liquidity_sweep", penetration_ticks=number(2, 1, 400, "pen_ticks"), max_penetration_ticks=number(0, 0, 2000, "max_ticks"), reclaim_bars=whole(3, 1, 100, "reclaim"))
def _sweep(m, **p):
    return D.sweeps(m.reference_levels, m.bars, m.step, m.tick, **p)


@event_concept("session_sweep", side=choice("sell-side", "sell-side", "buy-side"), penetration_ticks=number(2, 1, 400, "pen_ticks"), reclaim_bars=whole(3, 1, 100, "reclaim"), warmup=whole(30, 1, 500))
def _session_sweep(m, side, **p):
    return D.session_sweeps(m.bars, m.step, m.tick, sell=side == "sell-side", **p)


@event_concept("smt_divergence", **_SWING, lookback_bars=whole(40, 3, 2000, "lookback"), max_lag_bars=whole(3, 0, 50, "lag"), min_difference=number(0, 0, 10_000, "min_diff"))
def _smt(m, left, right, **p):
    if m.other is None:
        raise DefinitionError("this market has no comparison market")
    return D.smt(m.swings(left, right), m.bars, m.other, m.step, **p)


def concept(name: str) -> Concept:
    if name not in CONCEPTS:
        raise DefinitionError(f"unknown concept: {name}")
    return CONCEPTS[name]


def events(market: Market, name: str, params: dict | None = None) -> DataFrame:
    """The events of one concept: its checked parameters, then its detector."""
    c = concept(name)
    if not c.is_event:
        raise DefinitionError(f"{name} is a daily condition")
    return c.build(market, c.checked(params))


def checked_conditions(body: dict) -> tuple[dict[str, tuple[str, dict]], dict | str]:
    """Conditions by id with checked parameters, and the logic over them (all of them together where none is given)."""
    found = {}
    for i, given in enumerate(body["conditions"]):
        c = concept(given.get("type"))
        if c.is_event:
            raise DefinitionError(f"{c.name} is not a daily condition")
        found[str(given.get("id") or f"c{i + 1}")] = (c.name, c.checked(given.get("params")))
    logic = body.get("logic") or {"op": "AND", "items": list(found)}
    try:
        C.check_logic(logic, found)
    except ValueError as e:
        raise DefinitionError(str(e)) from None
    return found, logic


def compile_definition(body: str | dict, market: Market | None = None, daily: DataFrame | None = None) -> DataFrame:
    """A definition as a DataFrame of (symbol, at, direction): ``{"concept", "params"}`` over a market's candles, or
    ``{"conditions": [{"id", "type", "params"}], "logic"}`` over daily bars, where ``at`` is the day's midnight and the direction null.

    Unknown concepts, values out of bounds and logic that misses a condition raise DefinitionError before anything is read.
    """
    body = json.loads(body) if isinstance(body, str) else body
    if "concept" in body:
        if market is None:
            raise DefinitionError("an event definition needs candles")
        return events(market, body["concept"], body.get("params")).select("symbol", F.col("confirmed_at").alias("at"), "direction")
    found, logic = checked_conditions(body)
    if daily is None:
        raise DefinitionError("a condition definition needs daily bars")
    return C.evaluate(daily, found).filter(C.combine(logic)).select("symbol", F.col("date").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("direction"))


# --- tables of definitions -----------------------------------------------------------------------------

_BODY = "struct<concept: string, params: map<string, string>, conditions: array<struct<id: string, type: string, params: map<string, string>>>>"


def spec_table(spark: SparkSession) -> DataFrame:
    """One row per concept and parameter, one with a null parameter for each concept."""
    rows = [(c.name, None, None, None, None, None, None, None, -1) for c in CONCEPTS.values()]
    text = lambda v: str(v).lower() if isinstance(v, bool) else f"{v:g}" if isinstance(v, float) else str(v)
    for c in CONCEPTS.values():
        for i, (name, p) in enumerate(c.params.items()):
            options = [text(o) for o in (p.options or ((True, False) if p.kind == "flag" else ()))]
            rows.append((c.name, name, p.kind, text(p.default), float(p.low), float(p.high), options, next(iter([p.problem(object())])) if p.kind != "number" and p.kind != "int" else f"must be between {p.low:g} and {p.high:g}", i))
    return spark.createDataFrame(rows, "type string, param string, kind string, fallback string, low double, high double, options array<string>, rule string, place int")


def check_table(definitions: DataFrame) -> DataFrame:
    """Validate ``definitions(name, body)``: a row per definition and concept in it with its clean parameters or the first problem.

    (name, part, type, params, problem): ``part`` numbers the conditions of a definition, ``params`` is a map of text, ``problem`` is
    null for a concept that compiles.  Messages equal those of ``DefinitionError``.  Runs as one join with the small spec
    table, however many definitions there are.
    """
    body = F.from_json("body", _BODY)
    one = F.array(F.struct(F.lit(None).cast("string").alias("id"), F.col("b.concept").alias("type"), F.col("b.params").alias("params")))
    x = definitions.select("name", body.alias("b"))
    x = x.select("name", F.posexplode(F.when(F.col("b.concept").isNotNull() | F.col("b.conditions").isNull(), one).otherwise(F.col("b.conditions"))).alias("part", "c")).select("name", "part", "c.type", "c.params")
    x = x.join(spec_table(definitions.sparkSession).filter("param is not null or type is not null"), "type", "left")
    given = F.coalesce(F.try_element_at("params", F.col("param")), F.col("fallback"))
    num = given.try_cast("double")
    ranged = F.col("kind").isin("number", "int")
    bad = F.when(F.col("param").isNull(), F.lit(None).cast("string")).when(ranged & num.isNull(), F.lit("must be a number")).when(ranged & ~num.between(F.col("low"), F.col("high")), F.col("rule")).when(~ranged & ~F.array_contains("options", given), F.col("rule"))
    clean = F.when(F.col("kind") == "int", F.bround(num).cast("long").cast("string")).when(F.col("kind") == "number", num.cast("string")).otherwise(given)
    x = x.withColumns({"_bad": F.when(bad.isNotNull(), F.concat(F.col("type"), F.lit(": "), F.col("param"), F.lit(" "), bad)), "_clean": clean})
    g = x.groupBy("name", "part", "type").agg(
        F.min_by("_bad", F.when(F.col("_bad").isNotNull(), F.col("place"))).alias("problem"), F.max("place").alias("_known"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("param").isNotNull(), F.struct("param", "_clean"))))).alias("params"))  # at most a concept's parameters
    unknown = F.when(F.col("_known").isNull(), F.concat(F.lit("unknown concept: "), F.coalesce("type", F.lit("None"))))
    return g.select("name", "part", "type", F.when(F.coalesce(unknown, "problem").isNull(), F.col("params")).alias("params"), F.coalesce(unknown, "problem").alias("problem"))


class Definitions:
    """Saved definitions: JSON rows appended under a folder; the last row of a name (any case) counts.

    One automatic definition per concept at most: saving another takes its place.  ``compiled`` turns them into DataFrames.
    """

    SCHEMA = "key string, name string, body string, auto boolean, deleted boolean, version long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: Sequence[tuple]) -> None:
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def _rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(self.path)

    def all(self) -> DataFrame:
        """(name, body, auto) of the definitions that were not deleted."""
        last = self._rows().groupBy("key").agg(F.max_by(F.struct("name", "body", "auto", "deleted"), "version").alias("d"))
        return last.filter(~F.col("d.deleted")).select("d.name", "d.body", "d.auto")

    def save(self, name: str, body: dict, auto: bool = False) -> None:
        """Check a definition and store it; nothing is stored where the check fails."""
        if not name.strip():
            raise DefinitionError("a definition needs a name")
        if "concept" in body:
            body = {**body, "params": concept(body["concept"]).checked(body.get("params"))}
        else:
            checked_conditions(body)
        version = (self._rows().agg(F.max("version")).first()[0] or 0) + 1
        rows = [(name.strip().lower(), name.strip(), json.dumps(body, sort_keys=True), auto, False, version)]
        if auto and "concept" in body:
            same = F.from_json("body", _BODY)["concept"] == body["concept"]
            rows += [(r.name.lower(), r.name, r.body, False, False, version) for r in self.all().filter(F.col("auto") & same & (F.lower("name") != rows[0][0])).collect()]  # one at most
        self._append(rows)

    def delete(self, name: str) -> None:
        version = (self._rows().agg(F.max("version")).first()[0] or 0) + 1
        self._append([(name.strip().lower(), name.strip(), None, False, True, version)])

    def params(self, concept_name: str) -> dict:
        """Parameters of the automatic definition of a concept, else the defaults."""
        auto = self.all().filter(F.col("auto") & (F.from_json("body", _BODY)["concept"] == concept_name)).first()
        return concept(concept_name).checked(json.loads(auto.body)["params"] if auto else None)

    def compiled(self, names: Sequence[str], market: Market | None = None, daily: DataFrame | None = None) -> DataFrame:
        """The hits of some saved definitions: (name, symbol, at, direction)."""
        found = {r.name: r.body for r in self.all().filter(F.lower("name").isin([n.lower() for n in names])).collect()}  # those named
        lower = {n.lower(): n for n in found}
        if missing := [n for n in names if n.lower() not in lower]:
            raise DefinitionError(f"no definition named {missing[0]}")
        parts = [compile_definition(found[lower[n.lower()]], market, daily).select(F.lit(lower[n.lower()]).alias("name"), "symbol", "at", "direction") for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
