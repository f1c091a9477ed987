"""Greedy non-overlapping episodes and their forward outcomes (the only place future closes are read)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import change
from tidemark.operators import indicators as I
from tidemark.operators.ordered import by_symbol

PATH_LIMIT = 63  # fixed value: paths are only kept for horizons up to this length


def gap_count(max_gap_days: int | None) -> Column:
    """Running number of calendar gaps longer than ``max_gap_days`` up to each bar."""
    if max_gap_days is None:
        return F.lit(0)
    w = by_symbol()
    far = F.datediff("date", F.lag("date").over(w)) > max_gap_days
    return F.sum(F.when(far, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def with_forward(daily: DataFrame, horizon: int, warm: int, max_gap_days: int | None = 10, with_path: bool = False) -> DataFrame:
    """Exit date/close/return, elapsed bars and the gap mask around [t - warm, t + horizon]."""
    w = by_symbol()
    df = daily if "i" in daily.columns else I.numbered(daily)
    df = df.withColumn("_g", gap_count(max_gap_days))
    g_back = F.coalesce(F.lag("_g", warm).over(w), F.lit(0))
    g_last = F.max("_g").over(Window.partitionBy("symbol"))
    df = df.withColumns(
        {
            "exit_date": F.lead("date", horizon).over(w),
            "exit_price": F.lead("close", horizon).over(w),
            "elapsed": F.col("n") - 1 - F.col("i"),
            "gapped": F.coalesce(F.lead("_g", horizon).over(w), g_last) - g_back > 0,
        }
    )
    df = df.withColumn("forward_return", change(F.col("exit_price"), F.col("close")))
    if with_path and horizon <= PATH_LIMIT:
        closes = F.collect_list("close").over(w.rowsBetween(0, horizon))
        df = df.withColumn("path", F.when(F.col("exit_date").isNotNull(), F.transform(closes, lambda c: c / F.col("close") - 1)))
    return df.drop("_g")


def greedy_episodes(df: DataFrame, qualifies: str, horizon: int, first: int, keep: list[str]) -> DataFrame:
    """Pick episodes left to right; the next may start ``horizon + 1`` bars after the last.

    Candidates more than ``horizon`` bars apart cannot influence each other, so the fold runs per
    stretch of nearby candidates instead of per symbol.  Output: symbol, i, status, ``keep`` and
    per stretch the counters ``qualifying`` / ``skipped`` on its first row.
    """
    w = by_symbol("i")
    cand = df.filter(F.col(qualifies) & (F.col("i") >= first)).withColumn(
        "kind", F.when(F.col("exit_date").isNull(), F.when(F.col("gapped"), 3).otherwise(2)).when(F.col("gapped"), 1).otherwise(0)
    )
    far = F.coalesce(F.col("i") - F.lag("i").over(w) > horizon, F.lit(True))
    cand = cand.withColumn("_far", far.cast("int")).withColumn(
        "_stretch", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    grouped = cand.groupBy("symbol", "_stretch").agg(
        F.sort_array(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "kind", F.struct(*keep).alias("keep")))).alias("c")
    )
    start = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast("array<bigint>").alias("picks"), F.lit(0).cast("long").alias("skipped"))

    def step(acc, x):
        free = x["i"] >= acc["next"]
        take = free & x["kind"].isin(0, 2)
        return F.struct(
            F.when(free & (x["kind"] == 0), x["i"] + horizon + 1)
            .when(free & (x["kind"] >= 2), F.lit(2**62).cast("long"))
            .otherwise(acc["next"]).alias("next"),
            F.when(take, F.concat(acc["picks"], F.array(x["i"]))).otherwise(acc["picks"]).alias("picks"),
            (acc["skipped"] + F.when(free & (x["kind"] == 1), 1).otherwise(0)).cast("long").alias("skipped"),
        )

    folded = grouped.withColumn("f", F.aggregate("c", start, step))
    picked = F.filter("c", lambda x: F.array_contains(F.col("f.picks"), x["i"]))
    return (
        folded.select("symbol", F.size("c").alias("qualifying"), F.col("f.skipped").alias("skipped"), F.posexplode_outer(picked).alias("_p", "_e"))
        .select(
            "symbol", "_e.i",
            F.when(F.col("_e.kind") == 0, "complete").when(F.col("_e.kind") == 2, "pending").alias("status"),
            "_e.keep.*",
            F.when(F.coalesce(F.col("_p"), F.lit(0)) == 0, F.col("qualifying")).otherwise(0).alias("qualifying"),
            F.when(F.coalesce(F.col("_p"), F.lit(0)) == 0, F.col("skipped")).otherwise(0).alias("skipped"),
        )
    )


def episodes(daily: DataFrame, holds: Column, horizon: int, warm: int, max_gap_days: int | None = 10, with_path: bool = False,
             start: str | None = None) -> DataFrame:
    """Completed and pending episodes of a condition: trigger, exit, forward return."""
    df = with_forward(daily, horizon, warm, max_gap_days, with_path)
    q = F.coalesce(holds, F.lit(False))
    if start:
        q = q & (F.col("date") >= F.lit(start).cast("date"))
    df = df.withColumn("_q", q)
    keep = ["date", "close", "exit_date", "exit_price", "forward_return", "elapsed"] + (["path"] if "path" in df.columns else [])
    return greedy_episodes(df, "_q", horizon, warm, keep)


def completed(eps: DataFrame) -> DataFrame:
    return eps.filter("status = 'complete'").select("symbol", "i", F.col("date").alias("trigger_date"), "exit_date", F.col("forward_return").alias("v"))


def baseline(daily: DataFrame, horizon: int, warm: int, max_gap_days: int | None = 10) -> DataFrame:
    """The forward return from every evaluable, gap-free bar."""
    df = with_forward(daily, horizon, warm, max_gap_days)
    return df.filter((F.col("i") >= warm) & F.col("exit_date").isNotNull() & ~F.col("gapped")).select(
        "symbol", "i", "date", F.col("forward_return").alias("v")
    )


def greedy_spaced(cand: DataFrame, keys: list[str], index: str, spacing: int) -> DataFrame:
    """Left-to-right selection where a row is taken when it lies ``spacing`` or more after the last taken one."""
    w = Window.partitionBy(*keys).orderBy(index)
    far = F.coalesce(F.col(index) - F.lag(index).over(w) >= spacing, F.lit(True)).cast("int")
    x = cand.withColumn("_far", far).withColumn("_stretch", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = x.groupBy(*keys, "_stretch").agg(F.sort_array(F.collect_list(F.col(index).cast("long"))).alias("c"))
    start = F.array().cast("array<bigint>")
    taken = F.aggregate("c", start, lambda acc, i: F.when((F.size(acc) == 0) | (i >= F.try_element_at(acc, F.lit(-1)) + spacing), F.concat(acc, F.array(i))).otherwise(acc))
    picked = g.select(*keys, F.explode(taken).alias(index))
    return cand.join(picked, [*keys, index], "left_semi")
