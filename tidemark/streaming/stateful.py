"""Streams with keyed state on ``transformWithState``: gap lifecycles and the running session price.

State lives in the RocksDB store and rows are ordered by buffering them until the watermark has passed, so late and repeated rows
change nothing.  A key's ready rows are worked on as numpy arrays, all open gaps at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import calendar as cal
from tidemark.streaming.streams import LATE, tumbling_bars

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MARKS = ["created", "entered", "partial", "half", "full", "validated", "invalidated", "expired", "ended"]
REASONS = ["session ended", "age limit", "contract roll", "suspect data"]


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which keyed state needs."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class GapLife(StatefulProcessor):
    """Every mark of three-candle gaps of one symbol.

    State: bars that the watermark has not passed, the last two bars before them, and the open gaps.  A gap is open for at most
    ``max_age`` bars of one day, so the state is bounded.  A bar at or before the last one worked on is late and left out; of bars of
    one stamp the one that came last counts.
    """

    BAR = "t long, day long, regime long, suspect boolean, after_gap boolean, high double, low double, close double"
    GAP = "born long, day long, regime long, up boolean, top double, bottom double, seen long, entered boolean, partial boolean, half boolean, full boolean, validated boolean, last long"

    def __init__(self, step: int, max_age: int):
        self.step, self.max_age = step, max_age
        self.bar_names = [c.split()[0] for c in self.BAR.split(", ")]
        self.gap_names = [c.split()[0] for c in self.GAP.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending, self.tail, self.gaps = handle.getListState("pending", self.BAR), handle.getListState("tail", self.BAR), handle.getListState("gaps", self.GAP)

    def _held(self, state, names) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in state.get()], columns=names) if state.exists() else pd.DataFrame(columns=names)

    def _put(self, state, frame: pd.DataFrame) -> None:
        rows = list(frame.astype(object).itertuples(index=False, name=None))
        state.put(rows) if rows else state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[self.bar_names]
        bars = pd.concat([f for f in (self._held(self.pending, self.bar_names), new) if len(f)]).drop_duplicates("t", keep="last").sort_values("t")
        yield from self._work(key, bars, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._work(key, self._held(self.pending, self.bar_names), timerValues.getCurrentWatermarkInMs())

    def _work(self, key, bars: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        ready = bars[bars["t"].astype("int64") * 1000 <= watermark]
        rest = bars[bars["t"].astype("int64") * 1000 > watermark]
        self._put(self.pending, rest)
        if len(rest):  # look again when the watermark passes the earliest of them
            self.handle.registerTimer(int(rest["t"].iloc[0]) * 1000)
        tail = self._held(self.tail, self.bar_names)
        if len(tail):
            ready = ready[ready["t"] > tail["t"].iloc[-1]]
        if not len(ready):
            return
        x = pd.concat([tail, ready]) if len(tail) else ready
        kinds = dict(t="int64", day="int64", regime="int64", suspect=bool, after_gap=bool, high=float, low=float, close=float)
        c = {n: x[n].to_numpy(kinds[n]) for n in self.bar_names}
        first = len(tail)
        old = self._held(self.gaps, self.gap_names)
        made = self._created(c, first)
        out = [(self._side(made["up"]), made["born"], np.full(len(made["born"]), 0), made["born"], np.full(len(made["born"]), -1))]
        gaps = {n: np.concatenate([old[n].to_numpy(made[n].dtype), made[n]]) if len(old) else made[n] for n in self.gap_names}
        at = np.concatenate([np.full(len(old), first), made["at"] + 1])  # a gap's first bar to look at
        alive, marks = self._advance(c, gaps, at)
        out += marks
        self._put(self.gaps, pd.DataFrame({n: gaps[n][alive] for n in self.gap_names}))
        self._put(self.tail, x.iloc[-2:])
        side, born, mark, when, why = (np.concatenate(v) for v in zip(*out))
        if len(born):
            order = np.lexsort((mark, when, born))
            yield pd.DataFrame({"symbol": key[0], "direction": side[order], "born": born[order], "mark": [MARKS[m] for m in mark[order]], "at": when[order],
                                "reason": [None if w < 0 else "invalidated" if w == len(REASONS) else REASONS[w] for w in why[order]]})

    @staticmethod
    def _side(up: np.ndarray) -> np.ndarray:
        return np.where(up, "bullish", "bearish")

    def _created(self, c: dict, first: int) -> dict:
        i = np.arange(max(first, 2), len(c["t"]))
        dirty = c["suspect"] | c["after_gap"]
        up, down = c["high"][i - 2] < c["low"][i], c["low"][i - 2] > c["high"][i]
        joined = (c["t"][i] - c["t"][i - 2] == 2 * self.step) & (c["day"][i] == c["day"][i - 2]) & (c["day"][i] == c["day"][i - 1]) & ~(dirty[i] | dirty[i - 1] | dirty[i - 2])
        keep = joined & (up | down)
        i, up = i[keep], up[keep]
        no = np.zeros(len(i), bool)
        return {"at": i, "born": c["t"][i] + self.step, "day": c["day"][i], "regime": c["regime"][i], "up": up, "top": np.where(up, c["low"][i], c["low"][i - 2]), "bottom": np.where(up, c["high"][i - 2], c["high"][i]),
                "seen": np.zeros(len(i), np.int64), **{m: no.copy() for m in MARKS[1:6]}, "last": c["t"][i] + self.step}

    def _advance(self, c: dict, g: dict, at: np.ndarray) -> tuple[np.ndarray, list]:
        """Look at the new bars of all open gaps; (which stay open, marks)."""
        n, total = len(at), len(c["t"])
        if not n:
            return np.zeros(0, bool), []
        span = np.arange(self.max_age + 1)
        place = at[:, None] + span
        there = place < total
        p = np.minimum(place, total - 1)
        k = g["seen"][:, None] + 1 + span
        up = g["up"][:, None]
        top, bottom = g["top"][:, None], g["bottom"][:, None]
        low, high, close = c["low"][p], c["high"][p], c["close"][p]
        rules = [c["day"][p] != g["day"][:, None], k > self.max_age, c["regime"][p] != g["regime"][:, None], c["suspect"][p]]
        never = span.size
        first = lambda hit: np.where(hit.any(axis=1), hit.argmax(axis=1), never)
        stop = first(there & np.logical_or.reduce(rules))
        before = there & (span < stop[:, None])
        gone = first(before & np.where(up, close < bottom, close > top))
        live = before & (span <= gone[:, None])
        depth = np.where(up, top - low, high - bottom) / (top - bottom)
        hits = {"entered": depth >= 0, "partial": depth > 0, "half": depth >= 0.5, "full": depth >= 1}
        found = {m: np.where(g[m], never, first(live & hit)) for m, hit in hits.items()}
        since = np.where(g["entered"], -1, found["entered"])
        beyond = np.where(up, close > top, close < bottom)
        found["validated"] = np.where(g["validated"], never, first(live & (span < gone[:, None]) & beyond & (span >= since[:, None]) & (since[:, None] < never)))
        found["invalidated"] = gone
        closed = c["t"][p] + self.step
        out = []
        side = self._side(g["up"])

        def add(rows, mark, when, why=-1):
            out.append((side[rows], g["born"][rows], np.full(len(rows), MARKS.index(mark)), when, np.full(len(rows), why) if np.isscalar(why) else why))

        for mark, where in found.items():
            rows = np.flatnonzero(where < never)
            add(rows, mark, closed[rows, where[rows]])
            if mark != "invalidated":
                g[mark] = g[mark] | (where < never)
        rows = np.flatnonzero(gone < never)
        add(rows, "ended", closed[rows, gone[rows]], len(REASONS))
        rows = np.flatnonzero((gone == never) & (stop < never))
        ended = np.where(stop[rows] > 0, closed[rows, np.maximum(stop[rows] - 1, 0)], g["last"][rows])
        reason = np.argmax(np.stack([r[rows, stop[rows]] for r in rules]), axis=0)
        add(rows, "ended", ended, reason)
        old = reason <= 1
        add(rows[old], "expired", ended[old])
        alive = (gone == never) & (stop == never)
        count = there.sum(axis=1)
        g["last"] = np.where(count > 0, closed[np.arange(n), np.maximum(count - 1, 0)], g["last"])
        g["seen"] = g["seen"] + count
        return alive, out

    def close(self) -> None:
        pass


def gap_lifecycle(bars: DataFrame, step: int, max_age: int = 48, late: str = LATE) -> DataFrame:
    """Marks of three-candle gaps as bars arrive: (symbol, direction, born, mark, at, reason).

    ``bars``: symbol, ts, day, regime, suspect, after_gap, high, low, close.  A mark leaves once the watermark has passed its bar;
    ``ended`` rows say why.  Equal to the batch operator over the bars that the watermark has passed.
    """
    x = bars.select("symbol", "ts", F.unix_seconds("ts").alias("t"), F.unix_date("day").cast("long").alias("day"), F.col("regime").cast("long").alias("regime"), "suspect", "after_gap", "high", "low", "close").withWatermark("ts", late)
    schema = "symbol string, direction string, born long, mark string, at long, reason string"
    return x.groupBy("symbol").transformWithStateInPandas(GapLife(step, max_age), schema, "Append", "EventTime")


class SessionPrice(StatefulProcessor):
    """Sums of price x volume and volume, and extremes, of one symbol's trading day; the day's state goes when its end has passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "pv double, v double, high double, low double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows)).sort_values("ts")
        pv, v, high, low = self.sums.get() if self.sums.exists() else (0.0, 0.0, -np.inf, np.inf)
        volume = x["volume"].to_numpy(float)
        price = (x["high"] + x["low"] + x["close"]).to_numpy(float) / 3
        money, traded = pv + np.cumsum(price * volume), v + np.cumsum(volume)
        highs, lows = np.maximum(high, np.maximum.accumulate(x["high"].to_numpy(float))), np.minimum(low, np.minimum.accumulate(x["low"].to_numpy(float)))
        self.sums.update((float(money[-1]), float(traded[-1]), float(highs[-1]), float(lows[-1])))
        self.handle.registerTimer(int(x["day_end"].iloc[0].timestamp() * 1000))
        with np.errstate(invalid="ignore", divide="ignore"):
            vwap = np.where(traded > 0, money / traded, np.nan)
        yield pd.DataFrame({"symbol": key[0], "day": key[1], "ts": x["ts"], "vwap": vwap, "volume": traded, "high": highs, "low": lows})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sums.clear()
        return iter([])

    def close(self) -> None:
        pass


def session_vwap(ticks: DataFrame, size: str = "1 hour", late: str = LATE) -> DataFrame:
    """Running volume-weighted price and extremes of the trading day at each closed candle.

    Two stateful operators one after the other: candles close when the watermark passes them, then the day's sums go on from candle to
    candle; the watermark passes through by the candles' end.
    """
    b = tumbling_bars(ticks, size, late).withColumn("ends", F.col("closed_at") - F.expr("interval 1 microsecond"))
    b = b.withColumn("day", cal.trading_day(F.col("ts")))
    b = b.withColumn("day_end", cal.from_et(F.timestamp_seconds(F.unix_date("day") * 86400 + 17 * 3600)))
    schema = "symbol string, day date, ts timestamp, vwap double, volume double, high double, low double"
    return b.groupBy("symbol", "day").transformWithStateInPandas(SessionPrice(), schema, "Append", "EventTime")
