"""Quality checks on daily bars.  Real moves stay; only bad prints and invalid rows leave, and are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import by_symbol, first_rows

# Fixed values.
EXTREME_MOVE = 0.40
REVERT_TOLERANCE = 0.12
SPLIT_TOLERANCE = 0.06
SPLIT_DAYS = 4
COMMON_TOLERANCE = 0.03
COMMON_MIN_MOVE = 0.45
GAP_DAYS = 10
STALE_RUN = 5
VOLUME_SPIKE = 10
VOLUME_WINDOW = 50
VOLUME_MIN_DAYS = 30
OHLC_SLACK = 0.001
COMMON_SPLIT_RATIOS = [2, 3, 4, 5, 8, 10, 15, 20, 1 / 2, 1 / 3, 1 / 4, 1 / 5, 1 / 8, 1 / 10, 1 / 15, 1 / 20]


def valid_close(c: str = "close") -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0)


def invalid_counts(daily: DataFrame) -> DataFrame:
    return daily.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(valid_close(), F.lit(False))).alias("invalid"))


def dedupe_last(daily: DataFrame, arrival: str) -> DataFrame:
    """One row per (symbol, date), the last to arrive; a partial aggregate, so hot dates combine map-side."""
    cols = [c for c in daily.columns if c not in ("symbol", "date", arrival)]
    return daily.groupBy("symbol", "date").agg(F.max_by(F.struct(*cols), arrival).alias("_r")).select("symbol", "date", "_r.*")


def split_matches(moves: DataFrame, splits: DataFrame) -> DataFrame:
    """Extreme moves explained by a split recorded within four days.

    The splits are spread over the days they may explain, so the join is an equality on (symbol, date).
    """
    near = splits.select("symbol", F.explode(F.sequence(F.date_sub("date", SPLIT_DAYS), F.date_add("date", SPLIT_DAYS))).alias("date"), "ratio")
    hit = moves.select("symbol", "date", "jump").join(near, ["symbol", "date"])
    return hit.filter(F.abs(F.col("jump") * F.col("ratio") - 1) < SPLIT_TOLERANCE).groupBy("symbol", "date").agg(F.min("ratio").alias("split_ratio"))


def classify_moves(daily: DataFrame, splits: DataFrame) -> DataFrame:
    """Every row with ``check`` null or unadjusted_split / spike_and_revert / possible_split / extreme_move.

    A row right after a removed spike is not examined.  Ratios of neighbouring raw closes do not
    change when earlier prices are rescaled, so lag and lead of raw closes are enough.
    """
    w = by_symbol()
    x = daily.filter(valid_close()).withColumns({
        "jump": F.col("close") / F.lag("close").over(w),
        "_across": F.lead("close").over(w) / F.lag("close").over(w),
    })
    x = x.withColumn("_extreme", F.coalesce(F.abs(F.col("jump") - 1) > EXTREME_MOVE, F.lit(False)))
    found = split_matches(x.filter("_extreme"), splits)
    x = x.join(found, ["symbol", "date"], "left")
    spike = F.col("_extreme") & F.col("split_ratio").isNull() & F.coalesce(F.abs(F.col("_across") - 1) < REVERT_TOLERANCE, F.lit(False))
    x = x.withColumn("_spike", spike).withColumn("_rn", F.row_number().over(w))
    run = Window.partitionBy("symbol", "_spike").orderBy("date")
    x = x.withColumn("_island", F.col("_rn") - F.row_number().over(run))
    pos = F.row_number().over(Window.partitionBy("symbol", "_spike", "_island").orderBy("date"))
    x = x.withColumn("_bad", F.col("_spike") & (pos % 2 == 1))
    after = F.coalesce(F.lag("_bad").over(w), F.lit(False))
    ratios = F.array(*[F.lit(float(r)) for r in COMMON_SPLIT_RATIOS])
    common = F.exists(ratios, lambda r: F.abs(F.col("jump") * r - 1) < COMMON_TOLERANCE) & (F.abs(F.col("jump") - 1) > COMMON_MIN_MOVE)
    check = (
        F.when(~F.col("_extreme") | after, F.lit(None).cast("string"))
        .when(F.col("split_ratio").isNotNull(), "unadjusted_split").when(F.col("_bad"), "spike_and_revert")
        .when(common, "possible_split").otherwise("extreme_move")
    )
    return x.withColumn("check", check).drop("_extreme", "_spike", "_rn", "_island", "_bad", "_across")


def adjust(classified: DataFrame) -> DataFrame:
    """Drop bad prints and rescale everything before an unadjusted split by its jump."""
    after = by_symbol().rowsBetween(1, Window.unboundedFollowing)
    log = F.when(F.col("check") == "unadjusted_split", F.ln("jump")).otherwise(0.0)
    factor = F.exp(F.coalesce(F.sum(log).over(after), F.lit(0.0)))
    x = classified.withColumn("factor", factor).filter("check is null or check <> 'spike_and_revert'")
    return x.withColumns({**{c: F.col(c) * F.col("factor") for c in ("open", "high", "low", "close")}, "volume": F.col("volume") / F.col("factor")})


def date_gaps(daily: DataFrame, days: int = GAP_DAYS) -> DataFrame:
    gap = F.datediff("date", F.lag("date").over(by_symbol()))
    return daily.withColumn("gap_days", gap).filter(F.col("gap_days") > days).select("symbol", "date", "gap_days")


def stale_quotes(daily: DataFrame, run: int = STALE_RUN) -> DataFrame:
    """Reported once, on the day the run of unchanged closes without volume reaches ``run``."""
    w = by_symbol()
    same = (F.col("close") == F.lag("close").over(w)) & (F.coalesce("volume", F.lit(0.0)) == 0)
    x = daily.withColumn("_break", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    x = x.withColumn("_isl", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pos = F.row_number().over(Window.partitionBy("symbol", "_isl").orderBy("date"))
    return x.withColumn("_pos", pos).filter(F.col("_pos") == run).select("symbol", "date", "close")


def volume_spikes(daily: DataFrame) -> DataFrame:
    """Volume above ten times the median of the previous fifty days' non-zero volumes, ranked by size."""
    w = by_symbol()
    prev = w.rowsBetween(-VOLUME_WINDOW, -1)
    v = F.when(F.col("volume") > 0, F.col("volume"))
    x = daily.withColumn("_v", v).withColumns({"_n": F.count("_v").over(prev), "_m": F.percentile("_v", 0.5).over(prev), "_rn": F.row_number().over(w)})
    x = x.filter((F.col("_rn") > VOLUME_WINDOW) & (F.col("_n") >= VOLUME_MIN_DAYS) & (F.col("_m") > 0) & F.col("_v").isNotNull())
    x = x.withColumn("multiple", F.col("_v") / F.col("_m")).filter(F.col("multiple") > VOLUME_SPIKE)
    rk = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("multiple"), F.desc("date")))
    return x.withColumn("rank", rk).select("symbol", "date", "multiple", "rank")


def ohlc_inconsistent(daily: DataFrame) -> DataFrame:
    bad = (F.col("high") < F.greatest("open", "close") * (1 - OHLC_SLACK)) | (F.col("low") > F.least("open", "close") * (1 + OHLC_SLACK))
    return daily.groupBy("symbol").agg(F.count_if(bad).alias("inconsistent"))


def episode_flags(outcomes: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues dated inside [trigger, exit] of an episode; both sides are daily, so a symbol stays small."""
    i = issues.select("symbol", F.col("date").alias("_d"), "check")
    hit = outcomes.join(i, (outcomes.symbol == i.symbol) & F.col("_d").between(F.col("trigger_date"), F.col("exit_date")), "left").drop(i.symbol)
    return hit.groupBy("symbol", "i").agg(F.count("check").alias("flags"), F.array_join(F.array_sort(F.collect_set("check")), ",").alias("kinds"))
