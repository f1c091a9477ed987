"""Candles: building, resampling, session levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import ordered as O


def bars_from_ticks(ticks: DataFrame, seconds: int) -> DataFrame:
    """OHLCV per (symbol, clock bucket); first/last by (ts, event_id), all partial aggregates."""
    pos = F.struct("ts", "event_id")
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / seconds) * seconds)
    return (
        ticks.groupBy("symbol", bucket.alias("ts_"))
        .agg(
            F.min_by("price", pos).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", pos).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .withColumnRenamed("ts_", "ts")
    )


def prepare(bars: DataFrame, seconds: int) -> DataFrame:
    """Add position, contract regime, gap flag and contiguous-run number.

    ``regime`` counts contract changes; ``after_gap`` marks a bar that does not follow its same-day
    neighbour by one step; ``run`` is constant exactly over clean, step-exact stretches of one day
    and one regime, so two bars are contiguous when day and run agree.
    """
    # Contract changes and day neighbours are decided per day: one row per (symbol, day).
    days = bars.groupBy("symbol", "day").agg(
        F.min_by("contract", "ts").alias("_c0"), F.max_by("contract", "ts").alias("_c1"),
        F.count(F.lit(1)).alias("_n"),
    )
    inside = Window.partitionBy("symbol", "day").orderBy("ts")
    x = bars.withColumn("_pc", F.lag("contract").over(inside))
    change_in = x.groupBy("symbol", "day").agg(F.sum(F.when(F.col("_pc") != F.col("contract"), 1).otherwise(0)).alias("_in"))
    by_day = Window.partitionBy("symbol").orderBy("day")
    before = by_day.rowsBetween(Window.unboundedPreceding, -1)
    days = (
        days.join(change_in, ["symbol", "day"])
        .withColumn("_first", F.when(F.lag("_c1").over(by_day) != F.col("_c0"), 1).otherwise(0))
        .withColumn("_reg", F.coalesce(F.sum(F.col("_first") + F.col("_in")).over(before), F.lit(0)) + F.col("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("symbol", "day", "_reg", "_before")
    )
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    step = F.unix_seconds("ts") - F.lag(F.unix_seconds("ts")).over(inside)
    x = (
        x.join(days, ["symbol", "day"])
        .withColumn("bar_no", F.col("_before") + F.row_number().over(inside) - 1)
        .withColumn(
            "regime", F.col("_reg") + F.sum(F.when(F.col("_pc") != F.col("contract"), 1).otherwise(0)).over(upto)
        )
        .withColumn("after_gap", F.coalesce(step != seconds, F.lit(False)))
    )
    broken = F.coalesce(
        F.col("suspect") | F.col("after_gap") | F.lag("suspect").over(inside)
        | (F.col("regime") != F.lag("regime").over(inside)) | (step != seconds),
        F.lit(True),
    )
    x = x.withColumn("_b", F.when(broken, 1).otherwise(0)).withColumn("run", F.sum("_b").over(upto))
    return x.select(
        "symbol", "ts", "day", "contract", "open", "high", "low", "close", "volume", "suspect", "bar_no", "regime",
        "after_gap", "run",
    )


MIN_COVERAGE = 0.8  # fixed value: below this share of expected candles a resampled bar is suspect
LEVEL_COVERAGE = 0.9
ON_TIME_SECONDS = 30 * 60
DAY_END_MINUTE = 17 * 60


def seconds_interval(n: int):
    return F.expr(f"interval {n} seconds")


def day_open(day):
    return cal.day_start(day)


def at_clock(day, minute: int):
    """UTC instant of a New York clock time on a trading day."""
    return cal.from_et(F.timestamp_seconds(F.unix_date(day) * 86400 + minute * 60))


def open_steps(start, end, step: int):
    """Number of base candles in [start, end) while the market is normally open; a row-local expression."""
    every = seconds_interval(step)
    return F.when(end > start, F.size(F.filter(F.sequence(start, end - seconds_interval(1), every), cal.market_open))).otherwise(0)


def resample(bars: DataFrame, seconds: int, base_seconds: int) -> DataFrame:
    """Coarser candles: clock-aligned up to 1h, aligned to the day's start for 4h, the trading day for 1d."""
    start = day_open(F.col("day"))
    if seconds >= 86400:
        bucket, close = start, at_clock(F.col("day"), DAY_END_MINUTE)
    else:
        origin = F.unix_seconds(start) if seconds > 3600 else F.lit(0)
        t = F.unix_seconds("ts")
        bucket = F.timestamp_seconds(origin + F.floor((t - origin) / seconds) * seconds)
        close = bucket + seconds_interval(seconds)
    g = (
        bars.withColumn("_b", bucket).withColumn("_e", close).groupBy("symbol", "day", "_b", "_e")
        .agg(
            F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_base"),
            F.bool_or("suspect").alias("_s"), F.min("contract").alias("_c0"), F.max("contract").alias("_c1"),
        )
    )
    expected = open_steps(F.col("_b"), F.col("_e"), base_seconds)
    g = g.withColumn("n_expected", F.when(expected > 0, expected).otherwise(F.col("n_base")))
    return g.select(
        "symbol", F.col("_b").alias("ts"), "day", "open", "high", "low", "close", "volume", "n_base", "n_expected",
        (F.col("n_base") < F.col("n_expected")).alias("partial"),
        (F.col("_s") | (F.col("n_base") < MIN_COVERAGE * F.col("n_expected"))).alias("suspect"),
        F.when(F.col("_c0") == F.col("_c1"), F.col("_c0")).otherwise("mixed").alias("contract"),
    )


def with_atr(bars: DataFrame, period: int = 14, name: str = "atr", block: int = O.BLOCK_ROWS) -> DataFrame:
    """Simple mean of the true range over the last ``period`` bars; the previous close counts only inside a day."""
    def build(df, w):
        pc = F.when(F.lag("day").over(w) == F.col("day"), F.lag("close").over(w))
        tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
        df = df.withColumn("_tr", F.when(F.col("bar_no") == 0, F.col("high") - F.col("low")).otherwise(tr))
        f = w.rowsBetween(-period + 1, 0)
        return df.withColumn(name, F.when(F.col("bar_no") >= period - 1, F.avg("_tr").over(f))).drop("_tr")

    return O.rolling(bars, ["symbol"], period, 0, build, block=block)


def session_vwap(bars: DataFrame, anchor: str = "globex") -> DataFrame:
    """Running volume-weighted price since the session's start from clean bars; null outside the session."""
    inside = F.lit(True) if anchor == "globex" else cal.in_window(F.col("ts"), 9 * 60 + 30, 16 * 60)
    w = Window.partitionBy("symbol", "day", "_in").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    use = F.col("_in") & ~F.col("suspect") & (F.coalesce("volume", F.lit(0.0)) != 0)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    x = bars.withColumn("_in", inside).withColumn("_pv", F.when(use, tp * F.col("volume"))).withColumn("_v", F.when(use, F.col("volume")))
    return x.withColumn("vwap", F.when(F.col("_in"), F.try_divide(F.sum("_pv").over(w), F.sum("_v").over(w)))).drop("_in", "_pv", "_v")


def session_extremes(bars: DataFrame) -> DataFrame:
    """Highest high and lowest low of the session so far, clean bars only."""
    w = Window.partitionBy("symbol", "day").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("high_so_far", F.max(F.when(~F.col("suspect"), F.col("high"))).over(w)).withColumn(
        "low_so_far", F.min(F.when(~F.col("suspect"), F.col("low"))).over(w)
    )


def day_levels(bars: DataFrame, step: int, rth: bool = False) -> DataFrame:
    """Per trading day: clean high/low, coverage, regime, and whether the day is complete enough to use."""
    start = at_clock(F.col("day"), 570) if rth else day_open(F.col("day"))
    end = at_clock(F.col("day"), 960 if rth else DAY_END_MINUTE)
    x = bars.filter(cal.in_window(F.col("ts"), 570, 960)) if rth else bars
    clean = ~F.col("suspect")
    g = x.groupBy("symbol", "day").agg(
        F.max(F.when(clean, F.col("high"))).alias("high"), F.min(F.when(clean, F.col("low"))).alias("low"), F.count_if(clean).alias("clean"),
        F.min("ts").alias("first_ts"), F.min("regime").alias("regime"), F.max("regime").alias("last_regime"),
        F.max(F.when(F.col("ts") <= start, F.col("regime"))).alias("_reg_open"),
    )
    g = g.withColumns({"start": start, "end": end}).withColumn("expected", open_steps(F.col("start"), F.col("end"), step))
    g = g.withColumn("coverage", F.coalesce(F.try_divide("clean", "expected"), F.lit(0.0)))
    on_time = F.unix_seconds("first_ts") - F.unix_seconds("start") <= ON_TIME_SECONDS
    return g.withColumn("complete", F.col("high").isNotNull() & (F.col("coverage") >= LEVEL_COVERAGE) & on_time & (F.col("regime") == F.col("last_regime")))


def _pair(high_kind: str, low_kind: str):
    return F.explode(F.array(F.struct(F.lit(high_kind).alias("kind"), F.col("high").alias("price")), F.struct(F.lit(low_kind).alias("kind"), F.col("low").alias("price"))))


def previous_day_levels(days: DataFrame) -> DataFrame:
    """Previous day's high and low, usable through the next day if that day was complete and no roll lies between."""
    w = Window.partitionBy("symbol").orderBy("day")
    nxt = {"next_day": F.lead("day").over(w), "_next_open_reg": F.lead("_reg_open").over(w)}
    x = days.withColumns(nxt).filter(F.col("complete") & F.col("next_day").isNotNull())
    x = x.filter(F.coalesce("_next_open_reg", "last_regime") == F.col("regime"))
    x = x.withColumn("available_from", day_open(F.col("next_day"))).withColumn("valid_until", at_clock(F.col("next_day"), DAY_END_MINUTE))
    return x.select("symbol", _pair("pdh", "pdl").alias("l"), F.col("next_day").alias("day"), "available_from", "valid_until", "regime").select(
        "symbol", "l.kind", "l.price", "day", "available_from", "valid_until")


def overnight_levels(bars: DataFrame, step: int) -> DataFrame:
    """High and low from 18:00 to 09:30, usable for the rest of the day."""
    final = at_clock(F.col("day"), 570)
    night = cal.in_window(F.col("ts"), 18 * 60, 570)
    clean = ~F.col("suspect")
    g = bars.groupBy("symbol", "day").agg(
        F.max(F.when(night & clean, F.col("high"))).alias("high"), F.min(F.when(night & clean, F.col("low"))).alias("low"),
        F.count_if(night & clean).alias("clean"), F.min(F.when(night, F.col("ts"))).alias("first_ts"),
        F.min_by("regime", F.when(night, F.col("ts"))).alias("_r0"), F.max_by("regime", F.when(F.col("ts") <= final, F.col("ts"))).alias("_r1"),
    )
    g = g.withColumns({"start": day_open(F.col("day")), "available_from": final, "valid_until": at_clock(F.col("day"), DAY_END_MINUTE)})
    g = g.withColumn("expected", open_steps(F.col("start"), F.col("available_from"), step))
    late = F.unix_seconds("first_ts") - F.unix_seconds("start") > ON_TIME_SECONDS
    g = g.filter((F.col("expected") > 0) & (F.col("clean") >= LEVEL_COVERAGE * F.col("expected")) & ~late & (F.col("_r0") == F.col("_r1")))
    return g.select("symbol", _pair("onh", "onl").alias("l"), "day", "available_from", "valid_until").select(
        "symbol", "l.kind", "l.price", "day", "available_from", "valid_until")


def week_levels(days: DataFrame, min_days: int = 3) -> DataFrame:
    """Previous calendar week's high and low from complete days of one regime."""
    byday = Window.partitionBy("symbol").orderBy("day")
    x = days.withColumn("week", cal.week_start(F.col("day"))).withColumn("_open_reg", F.coalesce("_reg_open", F.lag("last_regime").over(byday)))
    g = x.groupBy("symbol", "week").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("complete").alias("ok"), F.min("regime").alias("_r0"), F.max("regime").alias("_r1"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.min("day").alias("first"), F.max("day").alias("last"), F.min_by("_open_reg", "day").alias("_or"))
    w = Window.partitionBy("symbol").orderBy("week")
    g = g.withColumns({"_nf": F.lead("first").over(w), "_nl": F.lead("last").over(w), "_nr": F.lead("_or").over(w)})
    g = g.filter(F.col("_nf").isNotNull() & (F.col("n") >= min_days) & F.col("ok") & (F.col("_r0") == F.col("_r1")) & (F.col("_nr") == F.col("_r0")))
    g = g.withColumns({"available_from": day_open(F.col("_nf")), "valid_until": at_clock(F.col("_nl"), DAY_END_MINUTE)})
    return g.select("symbol", _pair("pwh", "pwl").alias("l"), F.col("_nf").alias("day"), "available_from", "valid_until").select(
        "symbol", "l.kind", "l.price", "day", "available_from", "valid_until")


def opening_ranges(bars: DataFrame, step: int, minutes: int) -> DataFrame:
    """High and low of 09:30 + minutes when every candle is there and clean; known when the range ends."""
    start = at_clock(F.col("day"), 570)
    end = start + seconds_interval(minutes * 60)
    inside = (F.col("ts") >= start) & (F.col("ts") < end) & cal.in_window(F.col("ts"), 570, 960)
    g = bars.filter(inside).groupBy("symbol", "day").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("suspect").alias("_s"), F.max("high").alias("high"), F.min("low").alias("low"))
    g = g.filter((F.col("n") >= minutes * 60 // step) & ~F.col("_s"))
    return g.select("symbol", "day", "high", "low", (at_clock(F.col("day"), 570) + seconds_interval(minutes * 60)).alias("available_from"), at_clock(F.col("day"), 960).alias("valid_until"))


# Named session windows in New York minutes (start, end) and their level kinds.
SESSIONS = {
    "asia": ("asiah", "asial", 20 * 60, 0),
    "london": ("lonh", "lonl", 2 * 60, 5 * 60),
    "ny_am": ("nyamh", "nyaml", 9 * 60 + 30, 12 * 60),
}


def session_bounds(day, start: int, end: int):
    """UTC bounds of a window on a trading day; evening parts lie on the calendar day before."""
    evening = 18 * 60
    before = F.date_sub(day, 1)
    if start < end:
        d = before if start >= evening else day
        return at_clock(d, start), at_clock(d, end)
    return at_clock(before, start), at_clock(day, end)


def session_ranges(bars: DataFrame, step: int, sessions: dict = SESSIONS) -> DataFrame:
    """High and low of each named window with 90 % cover, clean and inside one regime."""
    tags = []
    for name, (hk, lk, a, b) in sessions.items():
        s, e = session_bounds(F.col("day"), a, b)
        tags.append(F.when((F.col("ts") >= s) & (F.col("ts") < e), F.struct(F.lit(name).alias("session"), F.lit(hk).alias("hk"), F.lit(lk).alias("lk"), s.alias("s"), e.alias("e"))))
    x = bars.withColumn("_t", F.explode(F.filter(F.array(*tags), lambda t: t.isNotNull()))).select("*", "_t.*")
    g = x.groupBy("symbol", "day", "session", "hk", "lk", "s", "e").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("suspect").alias("_s"), F.max("high").alias("high"), F.min("low").alias("low"), F.min("regime").alias("_r0"), F.max("regime").alias("_r1"))
    g = g.withColumn("expected", open_steps(F.col("s"), F.col("e"), step))
    g = g.filter((F.col("expected") > 0) & (F.col("n") >= LEVEL_COVERAGE * F.col("expected")) & ~F.col("_s") & (F.col("_r0") == F.col("_r1")))
    pair = F.explode(F.array(F.struct(F.col("hk").alias("kind"), F.col("high").alias("price")), F.struct(F.col("lk").alias("kind"), F.col("low").alias("price"))))
    return g.select("symbol", "session", pair.alias("l"), "day", F.col("e").alias("available_from"), at_clock(F.col("day"), DAY_END_MINUTE).alias("valid_until")).select(
        "symbol", "session", "l.kind", "l.price", "day", "available_from", "valid_until")
