"""Indicators on daily bars: every value at bar t uses bars up to t only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import change
from tidemark.operators.ordered import by_symbol

CLOSE = "close"


def numbered(daily: DataFrame) -> DataFrame:
    """Add the position ``i`` (0-based) and the symbol's length ``n``."""
    w = by_symbol()
    return daily.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))


def trailing(period: int, include_today: bool = True, order: str = "date"):
    w = by_symbol(order)
    return w.rowsBetween(-period + 1, 0) if include_today else w.rowsBetween(-period, -1)


def sma(period: int, column: str = CLOSE) -> Column:
    """Mean of the last ``period`` values, null until there are that many."""
    f = trailing(period)
    return F.when(F.count(column).over(f) == period, F.avg(column).over(f))


def trailing_mean(period: int, column: str) -> Column:
    """Mean of the ``period`` values before today."""
    f = trailing(period, include_today=False)
    return F.when(F.count(column).over(f) == period, F.avg(column).over(f))


def returns(column: str = CLOSE, lag: int = 1) -> Column:
    return change(F.col(column), F.lag(column, lag).over(by_symbol()))


def rolling_std(period: int, column: str) -> Column:
    f = trailing(period)
    return F.when(F.count(column).over(f) == period, F.stddev_samp(column).over(f))


def with_rsi(daily: DataFrame, period: int = 14, name: str = "rsi") -> DataFrame:
    """Wilder-smoothed RSI: seeded by the plain mean of the first ``period`` gains and losses.

    The recursion has no window form.  A symbol's daily history is bounded by the calendar, so it is one sorted array that a
    fold walks once; rows come back from the array, so nothing is joined.
    """
    move = F.coalesce(F.col(CLOSE) - F.lag(CLOSE).over(by_symbol()), F.lit(0.0)).cast("double")
    rows = daily.select(F.struct(*daily.columns).alias("row"), "symbol", "date", F.greatest(move, F.lit(0.0)).alias("up"), F.greatest(-move, F.lit(0.0)).alias("down"))
    days = rows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "up", "down", "row"))).alias("days"))

    def smoothed(before: Column, i: Column, x: Column) -> Column:
        """Sum until the seed is complete, then the mean that forgets 1 / period each day."""
        return F.when(i < period, before + x).when(i == period, (before + x) / period).otherwise(before + (x - before) / period)

    value = "struct<i:int,up:double,down:double>"
    start = F.struct(F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down")).cast(value).alias("last"), F.array().cast(f"array<{value}>").alias("path"))

    def step(acc: Column, day: Column) -> Column:
        i = acc["last"]["i"] + 1
        now = F.struct(i.alias("i"), smoothed(acc["last"]["up"], i, day["up"]).alias("up"), smoothed(acc["last"]["down"], i, day["down"]).alias("down"))
        return F.struct(now.alias("last"), F.concat(acc["path"], F.array(now)).alias("path"))

    path = F.aggregate("days", start, step, lambda acc: acc["path"])
    x = days.select(F.explode(F.arrays_zip(F.col("days").alias("d"), path.alias("s"))).alias("z"))
    s = F.col("z.s")
    rsi = F.when(s["i"] >= period, F.when(s["down"] == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(s["up"], s["down"]))))
    return x.select(F.col("z.d.row").alias("row"), rsi.alias(name)).select("row.*", name)


def momentum(daily: DataFrame, spans=(63, 126, 252)) -> DataFrame:
    """Latest returns over several spans, one-year population volatility, distance from the high."""
    w, year = by_symbol(), trailing(252)
    x = daily.withColumn("_r", returns())
    cols = {f"ret_{s}": change(F.col(CLOSE), F.lag(CLOSE, s).over(w)) for s in spans}
    cols["vol_1y"] = F.stddev_pop("_r").over(year) * F.sqrt(F.lit(252.0))
    cols["from_high"] = F.col(CLOSE) / F.max(CLOSE).over(year) - 1
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    return x.withColumns(cols).withColumn("_l", last).filter("_l = 1").select("symbol", "date", *cols)


def weekly(daily: DataFrame) -> DataFrame:
    """Monday-based weekly bars."""
    return daily.groupBy("symbol", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"),
    )


def range_summary(daily: DataFrame) -> DataFrame:
    g = daily.groupBy("symbol").agg(
        F.min_by("close", "date").alias("first"), F.max_by("close", "date").alias("last"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"),
    )
    return g.withColumn("change", F.col("last") / F.col("first") - 1)


def last_date(daily: DataFrame) -> Column:
    return F.max("date").over(Window.partitionBy("symbol"))


def slice_period(daily: DataFrame, days: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Fixed start/end dates, or the last ``days`` calendar days of every symbol."""
    if start:
        daily = daily.filter(F.col("date") >= F.lit(start).cast("date"))
    if end:
        daily = daily.filter(F.col("date") <= F.lit(end).cast("date"))
    if days:
        daily = daily.withColumn("_m", last_date(daily)).filter(F.col("date") >= F.date_sub("_m", days)).drop("_m")
    return daily
